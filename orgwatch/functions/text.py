"""Text functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words by which an event type falls into a category, in English and Chinese.
CATEGORIES = {
    "news": ["news", "新闻", "动态", "media"],
    "announcement": ["announcement", "公告", "通知", "发布", "声明"],
    "research": ["research", "研究", "论文", "报告", "科研"],
}
CHINESE_STOPWORDS = "的了是在和与及为被或"
ENGLISH_STOPWORDS = ["the", "and", "of", "to", "in", "a", "an", "is", "are", "this", "that"]
HAN = r"[\x{4E00}-\x{9FFF}]"
WIDE_HAN = r"\x{3400}-\x{9FFF}"


def collapse_ws(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_controls(c: Column) -> Column:
    """Control characters, no-break and ideographic spaces become single spaces."""
    return F.trim(F.regexp_replace(c, r"[\x{0000}-\x{001F}\x{007F}\x{00A0}\x{3000} ]+", " "))


def title_key(c: Column) -> Column:
    """Lower case without white space, punctuation, symbols."""
    return F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}_]+", "")


def norm_name(c: Column) -> Column:
    return collapse_ws(F.lower(F.trim(c)))


def loose_name(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), rf"[^a-z0-9{WIDE_HAN}]+", "")


def has_han(c: Column) -> Column:
    return c.rlike(HAN)


def han_ratio(c: Column) -> Column:
    """Han characters among all that are not white space; 0 for a blank text."""
    n = F.length(F.regexp_replace(c, r"\s+", ""))
    return F.when(n > 0, F.regexp_count(c, F.lit(HAN)) / n).otherwise(0.0)


def stopword_ratio(c: Column) -> Column:
    """Share of stop words: by character from 20 Han characters on, else by word from 10 on, else null. White space goes
    first, so that a word is a run of a to z between other characters."""
    bare = F.lower(F.regexp_replace(c, r"\s+", ""))
    han, words = F.regexp_count(c, F.lit(HAN)), F.regexp_count(bare, F.lit("[a-z]+"))
    chinese = F.regexp_count(c, F.lit(f"[{CHINESE_STOPWORDS}]"))
    english = F.regexp_count(bare, F.lit("(?<![a-z])(" + "|".join(ENGLISH_STOPWORDS) + ")(?![a-z])"))
    return F.when(han >= 20, chinese / han).when(words >= 10, english / words)


def truncate_marked(c: Column, n: int = 400) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def category(c: Column) -> Column:
    low, out = F.lower(F.coalesce(c, F.lit(""))), F.lit("other")
    for name, words in reversed(CATEGORIES.items()):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def note_field(c: Column, key: str) -> Column:
    """The value of ``key=`` in an audit note, null without one."""
    found = F.trim(F.regexp_extract(c, rf"{key}=([^;|]*)", 1))
    return F.when(found != "", found)


def error_class(c: Column) -> Column:
    m = F.coalesce(c, F.lit(""))
    return (
        F.when(m.rlike("(?i)timeout|timed out|ETIMEDOUT"), "api_timeout")
        .when(m.rlike(r"(?i)network|ECONN|ENOTFOUND|fetch failed|HTTP 5[0-9][0-9]"), "network_error")
        .when(m.rlike("(?i)empty completion|empty response|no response"), "network_error")
        .otherwise("llm_parse_failed")
    )


def canonical_name(c: Column) -> Column:
    """A name without bracketed parts and without a trailing year."""
    bare = F.regexp_replace(c, r"[(（\[【][^)）\]】]*[)）\]】]", " ")
    return collapse_ws(F.regexp_replace(bare, r"[\s,-]*(19|20)[0-9][0-9]\s*$", ""))


def entity_title(c: Column) -> Column:
    """As ``canonical_name``, but digits that belong to a name stay, as in a number that ends like a year: a year is what stands
    apart from the name before it."""
    bare = F.regexp_replace(c, r"[(（\[【][^)）\]】]*[)）\]】]", " ")
    return collapse_ws(F.regexp_replace(bare, r"[\s,-]+(19|20)[0-9][0-9]\s*$", ""))


def up_to_last(c: Column, close: str) -> Column:
    """A text up to the last match of ``close``, empty without one. A pattern that ends in ``close`` finds all its matches there,
    and none of its openings is left unclosed, so that it never reads on to the end of the text in vain."""
    return F.regexp_extract(c, f"(?is)^.*{close}", 0)


def within_last(c: Column, close: str, f: Callable[[Column], Column]) -> Column:
    """``c`` with ``f`` applied up to the last match of ``close``."""
    return F.transform(F.array(c), lambda x: F.transform(F.array(up_to_last(x, close)), lambda head: F.concat(f(head), F.substr(x, F.length(head) + 1)))[0])[0]


def drop_tags(c: Column) -> Column:
    """Tags become spaces; a < that no > follows stays."""
    return within_last(c, ">", lambda head: F.regexp_replace(head, "<[^>]+>", " "))


def visible_text(html: Column) -> Column:
    """A page's text by patterns alone: scripts, styles and tags become spaces."""
    for tag in ("script", "style"):
        html = within_last(html, f"</{tag}>", lambda head, tag=tag: F.regexp_replace(head, f"(?is)<{tag}.*?</{tag}>", " "))
    return collapse_ws(drop_tags(html))


def page_title(html: Column) -> Column:
    return collapse_ws(F.regexp_extract(up_to_last(html, "</title>"), r"(?is)<title[^<>]*>(.*?)</title>", 1))


_LABEL = r"(?i)^\s*(机构|单位|企业|公司|学校|高校|大学|院校|科研机构|实验室|医院|协会|学会|联盟|平台)(名称|名单|名录|全称)?\s*[：:]\s*"
_NUMBER = r"^\s*([（(]?[0-9]+[）).、]|[一二三四五六七八九十]+[、.])\s*"
_CONTEXT = r"(?i)^(由|与|和|及|以及|包括|例如|如|在|向|联合|依托|支持|来自|面向|位于|通过|针对|其中|本项目|该项目|合作方|合作单位|代表企业|代表机构|主要有|主要包括|名单包括|partners?\s+(with|include)\s+)"
_MARKS = "[\\s,，;；:：.。·—–_()（）\\[\\]【】{}'\"“”‘’-]+"
#: What is cut from a name, in this order.
NAME_CUTS = (_NUMBER, _LABEL, _NUMBER, _CONTEXT, f"^{_MARKS}|{_MARKS}$")


def clean_name(c: Column) -> Column:
    """A name without its label, list number, words of context before it and marks around it."""
    bare = strip_controls(c)
    for pattern in NAME_CUTS:
        bare = F.regexp_replace(bare, pattern, "")
    return collapse_ws(bare)


def name_key(c: Column) -> Column:
    """What two spellings of a name have in common."""
    return F.lower(F.regexp_replace(c, "[\\s—–_()（）\\[\\]【】{}'\"“”‘’.,，;；:：-]", ""))
