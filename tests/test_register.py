"""Functions by name in SQL give what their Column forms give."""

from orgwatch.functions import register
from orgwatch.functions.article import ARTICLE
from orgwatch.operators import extract
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
TEXTS = ["", " ", None, "Ab-c, D_e! 新闻。", "https://www.A.co.uk:443/x/../y?q=1#f", "http://u@b.org", "1. 公司名称: 某某大学", "unknown", "2024-02-30T01:02", "2024-05-06 07:08:09", '{"title": "T\\"x"', "suggested_name=New; x=1", "ETIMEDOUT it's", "Café Ünï", "<p>a<script>b</script>&amp;c</p><title>T</title><a href='x'>y</a>", "zhihu.com", "研究 the of and to in a an is are this that x"]


def test_every_function_equals_its_column_form(spark):
    names = register.register(spark)
    assert set(register.FUNCTIONS) | {"nfkd", "lcs_len", "body_text"} == set(names) and len(names) > 40
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(40).union(spark.read.parquet(f"{SF}/pages.parquet").select("html").limit(20))
    df = docs.union(spark.createDataFrame([(t,) for t in TEXTS], "text string")).withColumn("other", F.lit("https://www.a.co.uk/b/c.html")).withColumn("days", F.length("text").cast("long")).cache()
    df.createOrReplaceTempView("told")
    for name, (parameters, form) in register.FUNCTIONS.items():
        given = [p.split() for p in parameters.split(", ")]
        args = ["days" if kind == "BIGINT" else ("text", "other")[i] for i, (_, kind) in enumerate(given)]
        want = [r[0] for r in df.select(form(*[F.col(a) for a in args])).collect()]
        got = [r[0] for r in spark.sql(f"SELECT {name}({', '.join(args)}) FROM told").collect()]
        assert got == want, name
        if "nfkd" not in register.sql_body(name):
            plan = spark.sql(f"SELECT {name}({', '.join(args)}) FROM told")._jdf.queryExecution().executedPlan().toString()
            assert "Python" not in plan, name


def test_table_functions(spark):
    register.register_tables(spark)
    spark.read.parquet(f"{SF}/pages.parquet").createOrReplaceTempView("some_pages")
    pages = spark.table("some_pages")
    columns = [c.split()[0] for c in ARTICLE.split(", ")]
    got = spark.sql("SELECT a.* FROM some_pages p, LATERAL articles(p.url, p.html) a").select(*columns)
    want = extract.extract_articles(pages)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*columns).collect()))
    links = spark.sql("SELECT page_id, l.pos, l.href, l.text FROM some_pages p, LATERAL page_links(p.html) l")
    plain = extract.page_links(pages.select("page_id", "url", "html"))
    assert links.count() == plain.count() > 0
