"""Column functions over text; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a token, an entity and a citation look like, and which characters count as white space.
TOKEN = r"[a-zA-Z]+[0-9]*|[0-9]+(?:\.[0-9]+)?|[\u4e00-\u9fff]+"
ENTITY = r"[A-Z][a-z]{4,}"
CITATION = r"\bS\d+\b"
WHITE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\x1c-\x1f]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\u0085\u2028\u2029]"
CJK = r"[\u4e00-\u9fff]"
DIMENSION = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def find_all(text: Column | str, pattern: str) -> Column:
    """All matches of ``pattern``, whole; null text has none."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(pattern), F.lit(0))


def tokenize(text: Column | str) -> Column:
    """Lower-cased tokens: words with trailing digits, numbers, and runs of ideographs (one token each)."""
    return F.transform(find_all(text, TOKEN), F.lower)


def entities(text: Column | str) -> Column:
    """Capitalised words of five letters or more, distinct, in order of first appearance."""
    return F.array_distinct(find_all(text, ENTITY))


def strip(text: Column | str) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(_col(text), f"^{WHITE}+|{WHITE}+$", "")


def split_lines(text: Column | str) -> Column:
    """Lines without their ends; a final line end adds no empty line."""
    lines = F.split(_col(text), LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def or_else(*columns: Column | str) -> Column:
    """The first that is neither null nor empty."""
    *some, last = [_col(c) for c in columns]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in some], last)


def valid_text(content: Column | str) -> Column:
    """Bytes as UTF-8 text, malformed ones replaced."""
    return F.make_valid_utf8(_col(content).cast("string"))


def bucket(token: Column, dimension: int = DIMENSION) -> Column:
    """A token's dimension in the hashing embedding."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % dimension


def should_decompose(query: Column | str) -> Column:
    """Whether a question is worth splitting: over four characters, and several words or ideographs."""
    s = strip(F.coalesce(_col(query), F.lit("")))
    return (F.length(s) > 4) & ((F.size(F.split(s, r"\s+")) > 1) | s.rlike(CJK))


def split_paths(text: Column | str) -> Column:
    """Paths between commas of either width, trimmed, without empty ones."""
    parts = F.transform(F.split(F.replace(_col(text), F.lit("，"), F.lit(",")), ","), strip)
    return F.filter(parts, lambda x: x != "")


def mask_key(key: Column | str) -> Column:
    """What may be shown of a secret key."""
    k = _col(key)
    return F.when(k.isNull() | (k == ""), F.lit("<not set>")).when(F.length(k) <= 8, F.lit("sk-...****")).otherwise(F.concat(F.left(k, F.lit(3)), F.lit("..."), F.right(k, F.lit(4))))


def snippet(text: Column | str, n: int = 150) -> Column:
    return F.substring(F.replace(F.coalesce(_col(text), F.lit("")), F.lit("\n"), F.lit(" ")), 1, n)


def cited(answer: Column | str) -> Column:
    """Distinct citation ids in an answer."""
    return F.array_distinct(find_all(answer, CITATION))


def unknown_citations(answer: Column | str, valid: Column | str) -> Column:
    return F.array_except(cited(answer), _col(valid))


def parse_sub_queries(response: Column | str, query: Column | str) -> Column:
    """A JSON list from an answer that may stand in a code fence; the query itself where that yields nothing."""
    bare = F.regexp_replace(F.regexp_replace(strip(_col(response)), r"^```(?:json)?\s*", ""), r"\s*```$", "")
    items = F.filter(F.from_json(bare, "array<string>"), lambda x: x.isNotNull())
    return F.when(F.size(items) > 0, items).otherwise(F.array(_col(query)))


#: How the passages of a batch are headed in prompts and answers, and what may stand before an entity.
PASSAGE, BULLETS = "---段落", "-*· "


def parse_entity_response(response: Column | str, n: Column | int) -> Column:
    """Entities of n passages from one answer, array<array<string>>: a line each, under a heading a passage.

    Blank lines don't count, and neither do headings with nothing under them; missing passages, and all of a null answer,
    have no entities, and more than n are dropped.
    """
    n = F.lit(n) if isinstance(n, int) else n
    passages = F.split(F.coalesce(_col(response), F.lit("")), rf"(?:^|\n){WHITE}*{PASSAGE}[^\n]*")
    lines = lambda p: F.filter(F.transform(F.split(p, "\n"), strip), lambda x: x != "")
    found = F.filter(F.transform(passages, lambda p: F.transform(lines(p), lambda x: F.regexp_replace(x, f"^[{BULLETS}]+", ""))), lambda x: F.size(x) > 0)
    return F.slice(F.concat(found, F.array_repeat(F.array().cast("array<string>"), n)), F.lit(1), n)


def endpoint_problem(url: Column | str, allow_remote_http: bool = False) -> Column:
    """Why a service address is not acceptable, or null; the rules apply in order."""
    u = strip(F.coalesce(_col(url), F.lit("")))
    part = lambda name: F.try_parse_url(u, F.lit(name))
    scheme, host, user = F.lower(part("PROTOCOL")), F.regexp_replace(F.lower(part("HOST")), r"^\[|\]$", ""), part("USERINFO")
    local = host.isin("localhost", "127.0.0.1", "::1")
    problem = (
        F.when(u == "", "empty")
        .when(F.length(u) > 2048, "too long")
        .when(scheme.isNull() & ~u.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), "scheme")
        .when(scheme.isNull(), "malformed")
        .when(~scheme.isin("http", "https") | host.isNull() | (host == ""), "scheme")
        .when(user.isNotNull(), "credentials")
    )
    return problem if allow_remote_http else problem.when((scheme == "http") & ~local, "remote http")


def clean_endpoint(url: Column | str) -> Column:
    return F.when(endpoint_problem(url).isNull(), F.rtrim(strip(_col(url)), F.lit("/")))
