"""The functions for SQL: ``register(spark)`` makes all of them callable by name in SQL texts.

A native function becomes an SQL function whose body is the text of its own expression, so it is inlined where it is called
and is optimized and compiled like the Column form. The two that Spark has no expressions for stay Python functions over
batches. ``register_tables(spark)`` adds table functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..operators import extract, views
from . import article, dates, markup, normalize, text, urls

#: Name: parameters of SQL, and the Column form over them.
FUNCTIONS: dict[str, tuple[str, Callable[..., Column]]] = {
    "collapse_ws": ("c STRING", text.collapse_ws),
    "strip_controls": ("c STRING", text.strip_controls),
    "nfkd": ("c STRING", normalize.decomposed),
    "norm_ascii_han": ("c STRING", normalize.norm_ascii_han),
    "norm_letters": ("c STRING", normalize.norm_letters),
    "title_key": ("c STRING", text.title_key),
    "norm_name": ("c STRING", text.norm_name),
    "loose_name": ("c STRING", text.loose_name),
    "compact_name": ("c STRING", normalize.compact),
    "name_key": ("c STRING", text.name_key),
    "clean_name": ("c STRING", text.clean_name),
    "slug": ("c STRING", normalize.slug),
    "canonical_name": ("c STRING", text.canonical_name),
    "han_ratio": ("c STRING", text.han_ratio),
    "has_han": ("c STRING", text.has_han),
    "stopword_ratio": ("c STRING", text.stopword_ratio),
    "truncate_marked": ("c STRING", text.truncate_marked),
    "decode_entities": ("c STRING", extract.decode_entities),
    "strip_tags": ("c STRING", extract.strip_tags),
    "visible_text": ("html STRING", text.visible_text),
    "page_title": ("html STRING", text.page_title),
    "page_anchors": ("html STRING", extract.anchors),
    "canonical_url": ("url STRING", urls.canonical_url),
    "url_host": ("url STRING", urls.host),
    "site_key": ("h STRING", urls.site_key),
    "domain_suffix": ("url STRING", urls.domain_suffix),
    "official_domain": ("url STRING", urls.official_domain),
    "is_official": ("source_url STRING, website STRING", urls.is_official),
    "resolve_url": ("href STRING, base STRING", urls.resolve_url),
    "article_id": ("url STRING", urls.article_id),
    "is_platform_host": ("h STRING", urls.is_platform_host),
    "is_blocked_host": ("h STRING", urls.is_blocked_host),
    "url_safety": ("url STRING", urls.url_safety),
    "event_date_from": ("told STRING, url STRING", dates.event_date_from),
    "valid_event_date": ("c STRING", dates.valid_event_date),
    "display_date": ("c STRING", dates.display_date),
    "parse_time": ("c STRING", dates.parse_time),
    "time_bucket": ("days BIGINT", dates.time_bucket),
    "event_category": ("c STRING", text.category),
    "error_class": ("c STRING", text.error_class),
    "suggested_name": ("note STRING", lambda c: text.note_field(c, "suggested_name")),
    "structured_title": ("c STRING", lambda c: views.structured_field(c, "title", F.lit(""))),
}
PYTHON = {"lcs_len": normalize.lcs_len, "body_text": None}

_INFIX = {"=", "<=>", "<", "<=", ">", ">=", "and", "or", "+", "-", "*", "/", "%", "rlike", "like", "ilike"}


def _listed(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _sql(node) -> str:
    """The SQL text of an expression that has been built but not analyzed."""
    kind = node.getClass().getSimpleName()
    if kind == "UnresolvedFunction":
        name, args = node.functionName(), [_sql(a) for a in _listed(node.arguments())]
        if name.lower() in _INFIX and len(args) == 2:
            return f"({args[0]} {name} {args[1]})"
        if name == "!":
            return f"(NOT {args[0]})"
        if name == "in":
            return f"({args[0]} IN ({', '.join(args[1:])}))"
        return f"{name}({', '.join(args)})"
    if kind == "LambdaFunction":
        names = [a.sql() for a in _listed(node.arguments())]
        return f"{names[0] if len(names) == 1 else '(' + ', '.join(names) + ')'} -> {_sql(node.function())}"
    if kind == "CaseWhenOtherwise":
        branches = "".join(f" WHEN {_sql(b._1())} THEN {_sql(b._2())}" for b in _listed(node.branches()))
        rest = node.otherwise()
        return f"(CASE{branches}{f' ELSE {_sql(rest.get())}' if rest.isDefined() else ''} END)"
    if kind == "Cast":
        word = "TRY_CAST" if node.sql().startswith("TRY_CAST") else "CAST"
        return f"{word}({_sql(node.child())} AS {node.dataType().sql()})"
    if kind == "UnresolvedExtractValue":
        return f"{_sql(node.child())}[{_sql(node.extraction())}]"
    if kind == "Alias":
        return f"{_sql(node.child())} AS {_listed(node.name())[0]}"
    return node.sql()


def sql_body(name: str) -> str:
    """The body of a function of ``FUNCTIONS`` as an SQL expression over its parameters."""
    parameters, form = FUNCTIONS[name]
    made = form(*[F.col(p.split()[0]) for p in parameters.split(", ")])
    return _sql(made._jc.node())


def register(spark: SparkSession) -> list[str]:
    """All functions by name, for the session: the native ones as SQL functions, the others as Python ones."""
    python = PYTHON | {"body_text": markup.body_text_udf()}
    for name, f in python.items():
        spark.udf.register(name, f)
    for name, (parameters, _) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {sql_body(name)}")
    return sorted([*python, *FUNCTIONS])


@udtf(returnType=article.ARTICLE)
class Articles:
    """The structured article of a page, as a row, or no row where none is found."""

    def eval(self, url: str, html: str, least: int = 120):
        found = article.read_article(url, html, least)
        if found:
            yield tuple(found[c.split()[0]] for c in article.ARTICLE.split(", "))


@udtf(returnType="pos int, href string, text string")
class Links:
    """The anchors of a page in order: their addresses as they stand and their texts."""

    def eval(self, html: str):
        for pos, (href, label) in enumerate(markup.links(html or "")):
            yield pos, href, label


def register_tables(spark: SparkSession) -> list[str]:
    """Table functions: ``articles(url, html[, least])`` and ``page_links(html)``, to be joined laterally with pages."""
    tables = {"articles": Articles, "page_links": Links}
    for name, f in tables.items():
        spark.udtf.register(name, f)
    return sorted(tables)
