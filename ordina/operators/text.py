"""Normalisation, classification and masking of text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.strings import upper
from ..registry import query
from ..sources.tables import LINES_SQL, lines, table
from .sequences import escaped, escaped_sql

# Typographic characters and what they become (fixed values); the soft hyphen goes.
_DASHES = "‐‑–—’"
_PLAIN = "----'"
_SOFT_HYPHEN = "­"


@F.pandas_udf(T.StringType())
def nfkd(values: pd.Series) -> pd.Series:
    """Compatibility decomposition without combining marks; no built-in does this."""
    return values.map(lambda v: None if v is None else "".join(c for c in unicodedata.normalize("NFKD", v) if not unicodedata.combining(c)))


def normalized(c: Column) -> Column:
    """The form in which names and texts are compared."""
    return F.lower(nfkd(F.replace(F.translate(c, _DASHES, _PLAIN), F.lit(_SOFT_HYPHEN), F.lit(""))))


@query("normalize_nfkd")
def normalize_nfkd(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(normalized(F.col("text")), 256).alias("sha256"))


@query("compact_key")
def compact_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.regexp_replace(normalized(F.col("text")), "[^a-z0-9]", ""), 256).alias("sha256"))


@query("dash_normalization", "SELECT doc_id, md5(lower(replace(translate(text, '‐‑–—’', '----'''), chr(173), ''))) AS digest FROM documents")
def dash_normalization(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower(F.replace(F.translate("text", _DASHES, _PLAIN), F.lit(_SOFT_HYPHEN), F.lit("")))).alias("digest"))


# Captions (fixed values): a line that begins with a label, and a label within a caption.
_LABEL = r"(?i)^\s*(Figure|Fig\.?|Table)\s+((?:[A-Z][.\-]?)?\d+(?:\.\d+)*[A-Z]?|[IVX]+|[A-Z])\s*([:.])\s*"
_NAME = r"(?i)\b(?:Figure|Fig\.|Table)\s*([A-Za-z]?\.?\d+(?:[.][\d]+)?[A-Za-z]?)\s*[:.]?"


@query(
    "caption_labels",
    rf"""WITH c AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE l_returnflag WHEN 'A' THEN 'FIGURE ' WHEN 'N' THEN 'Fig. ' ELSE 'Tab ' END
 || CASE l_suppkey % 6 WHEN 0 THEN 'A.1' WHEN 1 THEN '3a' WHEN 2 THEN 'IV' WHEN 3 THEN '2.1' WHEN 4 THEN 'B' ELSE CAST(l_linenumber AS VARCHAR) END || CASE l_linestatus WHEN 'F' THEN ': ' ELSE '. ' END || 'text' AS t FROM lineitem)
 SELECT k, n, p, coalesce(nullif(regexp_extract(t, '{_LABEL}', 2), ''), 'unnumbered') AS label, coalesce(nullif(regexp_extract(t, '{_NAME}', 1), ''), 'unnumbered') AS name,
 CASE regexp_extract(t, '{_LABEL}', 3) WHEN ':' THEN 'strong' WHEN '.' THEN 'ambiguous_period' ELSE 'none' END AS confidence, count(*) AS rows FROM c GROUP BY ALL""",
)
def caption_labels(spark, d):
    kind = F.when(F.col("l_returnflag") == "A", "FIGURE ").when(F.col("l_returnflag") == "N", "Fig. ").otherwise("Tab ")
    k = F.col("l_suppkey") % 6
    number = F.when(k == 0, "A.1").when(k == 1, "3a").when(k == 2, "IV").when(k == 3, "2.1").when(k == 4, "B").otherwise(F.col("l_linenumber").cast("string"))
    text = F.concat(kind, number, F.when(F.col("l_linestatus") == "F", ": ").otherwise(". "), F.lit("text"))
    c = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), text.alias("t"))
    return c.groupBy("k", "n", "p", caption_label(F.col("t")).alias("label"), caption_name(F.col("t")).alias("name"), label_confidence(F.col("t")).alias("confidence")).agg(F.count("*").alias("rows"))


def _group(c: Column, pattern: str, i: int) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")), F.lit("unnumbered"))


def caption_label(c: Column) -> Column:
    """The name in the label that a line begins with."""
    return _group(c, _LABEL, 2)


def caption_name(c: Column) -> Column:
    """The name in the first label of a caption, wherever it stands."""
    return _group(c, _NAME, 1)


def label_confidence(c: Column) -> Column:
    mark = F.regexp_extract(c, _LABEL, 3)
    return F.when(mark == ":", "strong").when(mark == ".", "ambiguous_period").otherwise("none")


# Patterns that Java and RE2 read alike (fixed values).
_CONTACT = [(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[anonymous contact]"), (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[anonymous address]"), (r"\+[0-9]+ \([0-9]{3}\) [0-9]{3}-[0-9]{4}", "[anonymous phone]")]
_SECRET = [(r"[Bb]earer [A-Za-z0-9._-]+", "[REDACTED]"), (r"sk-[A-Za-z0-9_-]{8,}", "[REDACTED]"), (r'(token|password|secret)( ?[=:] ?"?)[A-Za-z0-9+/_.=-]{12,}', r"$1$2[REDACTED]")]


def masked(c: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, new in rules:
        c = F.regexp_replace(c, pattern, new)
    return c


def masked_sql(c: str, rules: list[tuple[str, str]]) -> str:
    for pattern, new in rules:
        c = f"regexp_replace({c}, '{pattern}', '{new.replace('$', chr(92))}', 'g')"
    return c


@query("contact_masking", f"SELECT doc_id, md5({masked_sql('text', _CONTACT)}) AS digest, CAST({masked_sql('text', _CONTACT)} <> text AS BIGINT) AS changed FROM documents")
def contact_masking(spark, d):
    new = masked(F.col("text"), _CONTACT)
    return table(spark, d, "documents").select("doc_id", F.md5(new).alias("digest"), (new != F.col("text")).cast("bigint").alias("changed"))


@query("secret_masking", f"SELECT doc_id, md5({masked_sql('text', _SECRET)}) AS digest, CAST({masked_sql('text', _SECRET)} <> text AS BIGINT) AS changed FROM documents")
def secret_masking(spark, d):
    """Bearer tokens, keys and assigned secrets are masked in the whole text."""
    new = masked(F.col("text"), _SECRET)
    return table(spark, d, "documents").select("doc_id", F.md5(new).alias("digest"), (new != F.col("text")).cast("bigint").alias("changed"))


_STATUS_LINE = r"^(Licensed under|Released under|This work is licensed)"


@query("status_line_filter", f"WITH {LINES_SQL} SELECT doc_id, line_id, line FROM lines WHERE regexp_matches(line, '{_STATUS_LINE}')")
def status_line_filter(spark, d):
    return lines(spark, d).where(F.col("line").rlike(_STATUS_LINE))


def heading(line: Column, bold: Column) -> Column:
    """Short lines with more than three Latin letters that are bold, or all upper case and no formula."""
    t = F.btrim(line, F.lit(" \t\r"))
    letters = F.length(F.regexp_replace(t, "[^A-Za-z]", "")) > 3
    return (F.length(t) < 110) & letters & (bold | (~t.rlike("[a-z]") & (upper(t) == t) & ~t.rlike("[=∈∑]")))  # most lines have such letters, which cost less to find


@query(
    "heading_lines",
    f"""WITH {LINES_SQL}, t AS (SELECT doc_id, line_id % 7 = 3 AS bold, trim(CASE WHEN line_id % 5 = 1 THEN upper(line) WHEN line_id % 5 = 2 THEN upper(line) || ' = 1' ELSE line END, ' ' || chr(9) || chr(13)) AS line FROM lines)
 SELECT doc_id, count(*) AS lines, CAST(count_if(length(line) < 110 AND length(regexp_replace(line, '[^A-Za-z]', '', 'g')) > 3 AND (bold OR (upper(line) = line AND NOT regexp_matches(line, '[=∈∑]')))) AS BIGINT) AS headings FROM t GROUP BY doc_id""",
)
def heading_lines(spark, d):
    n, line = F.col("line_id"), F.col("line")
    shown = F.when(n % 5 == 1, upper(line)).when(n % 5 == 2, F.concat(upper(line), F.lit(" = 1"))).otherwise(line)
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(heading(shown, n % 7 == 3)).alias("headings"))


# What a line of a manuscript says of its authors, most telling first (fixed values; lines are compared in their normal form).
CLASSES = {
    "publication_status": r"^(published as|under review as|accepted as).*conference paper|paper under double.blind review",
    "identity_section_heading": r"^(\d+[. ]*)?(acknowledge?ments?|author contributions?|contribution statement|funding( statement)?)$",
    "author_footnote": r"correspond(ing|ence)|equal contribution|work (was )?(done|performed)|project lead|core contributor",
    "author_contact": "@",
    "author_project_link": r"(our |the )?(code|implementation|project|website|repository).{0,55}(available|https?[:/]|github)",
}


def redaction_reason(line: Column, in_section: Column | None = None, gutter: Column | None = None) -> Column:
    """Why a line would be masked, null if it would not: its class, a margin number, or the section it stands in."""
    text = F.lower(line)
    rules = [(text.rlike(p), n) for n, p in CLASSES.items()]
    rules.insert(1, (F.lit(False) if gutter is None else gutter, "line_number"))
    rules.insert(3, (F.lit(False) if in_section is None else in_section & ~text.rlike(r"^\d+$"), "identity_section"))
    out = F.when(*rules[0])
    for condition, name in rules[1:]:
        out = out.when(condition, name)
    return out


_SAMPLES = [
    "Published as a conference paper at X 2026", "Acknowledgements", "3. Funding Statement", "Funding of arts", "* Equal contribution.", "Work was done at Y", "mail a@b.org", "Our code is available at http://c.org",
    "The repository is https://d.org", "007", "Plain prose about trees.", "Paper under double-blind review", "Corresponding author: Z",
]
_WANTED = ["publication_status", "identity_section_heading", "identity_section_heading", None, "author_footnote", "author_footnote", "author_contact", "author_project_link", "author_project_link", "line_number", None, "publication_status", "author_footnote"]


@query(
    "redaction_reasons",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND w IS NULL OR (o_orderstatus = 'P' AND w IN ('author_footnote', 'author_contact', 'author_project_link')) THEN 'identity_section' ELSE w END AS reason FROM (SELECT *, CASE o_orderkey % "
    + f"{len(_SAMPLES)} {' '.join(f'WHEN {i} THEN {chr(39) + w + chr(39) if w else chr(78) + chr(85) + chr(76) + chr(76)}' for i, w in enumerate(_WANTED))} END AS w FROM orders)",
)
def redaction_reasons(spark, d):
    line = F.element_at(F.array(*[F.lit(s) for s in _SAMPLES]), (F.col("o_orderkey") % len(_SAMPLES) + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", redaction_reason(line, F.col("o_orderstatus") == "P", line.rlike("^[0-9]{3}$")).alias("reason"))


_REPLACEMENT = {"author_project_link": "[anonymous link]", "author_name": "Anonymous", "identity_section_heading": "[Identity details omitted]", "publication_status": "Anonymous manuscript"}


@query("reason_replacements", "SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN '[anonymous link]' WHEN 1 THEN 'Anonymous' WHEN 2 THEN '[Identity details omitted]' WHEN 3 THEN 'Anonymous manuscript' ELSE '' END AS shown FROM orders")
def reason_replacements(spark, d):
    """What stands where a line was masked, by its reason."""
    reason = F.element_at(F.array(*[F.lit(r) for r in (*_REPLACEMENT, "author_contact")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", replacement(reason).alias("shown"))


def replacement(reason: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(v) for pair in _REPLACEMENT.items() for v in pair]), reason), F.lit(""))


@query("blank_line_filter", f"WITH {LINES_SQL} SELECT doc_id, count(*) AS lines, CAST(count_if(trim(line, ' ' || chr(9) || chr(13)) <> '') AS BIGINT) AS filled FROM lines GROUP BY doc_id")
def blank_line_filter(spark, d):
    return lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.btrim("line", F.lit(" \t\r")) != "").alias("filled"))


@query("html_escape", f"SELECT page_id, md5({escaped_sql('html')}) AS digest FROM pages")
def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(escaped(F.col("html"))).alias("digest"))


@query("link_extract", """SELECT page_id, uri, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS uri FROM pages) GROUP BY page_id, uri""")
def link_extract(spark, d):
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("uri")).groupBy("page_id", "uri").agg(F.count("*").alias("n"))


@query("author_list_split", "SELECT c_custkey, array_to_string([trim(x) for x in string_split(c_name || '; ' || c_mktsegment || ';', ';') if trim(x) <> ''], '|') AS authors FROM customer")
def author_list_split(spark, d):
    parts = F.split(F.concat("c_name", F.lit("; "), "c_mktsegment", F.lit(";")), ";", -1)
    return table(spark, d, "customer").select("c_custkey", F.array_join(F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != ""), "|").alias("authors"))


def name_variants(name: Column) -> Column:
    """How a name (in its normal form) may be written, as patterns, the longest first: all words; of three or more, the
    first and last, and those of more than one letter; the first and last with up to four initials between. A single
    short word is none, so it matches nothing."""
    words = F.regexp_extract_all(name, F.lit("([a-z]+)"), 1)
    n, first, last = F.size(words), F.element_at(words, 1), F.element_at(words, -1)
    wide = F.filter(words, lambda w: F.length(w) > 1)
    joined = lambda parts: F.array_join(parts, r"[\s.\-]+")
    sized = lambda parts, pattern: F.struct((-F.length(F.array_join(parts, ""))).alias("size"), pattern.alias("pattern"))
    initials = F.concat(first, F.lit(r"[\s\-]+(?:[a-z][.\s]+){0,4}"), last)
    some = F.array_compact(F.array(
        F.when((n > 1) | (F.length(first) >= 6), sized(words, joined(words))), F.when(n >= 3, sized(F.array(first, last), joined(F.array(first, last)))),
        F.when((n >= 3) & ((F.size(wide) > 1) | (F.length(F.element_at(wide, 1)) >= 6)), sized(wide, joined(wide))), F.when(n >= 2, sized(F.array(first, last, F.lit("__initials__")), initials)),
    ))
    return F.when(n > 0, F.array_distinct(F.transform(F.array_sort(some), lambda v: v["pattern"]))).otherwise(F.array().cast("array<string>"))


def author_pattern(names: Column) -> Column:
    """One pattern for a name or a list of names, whose matches stand between characters that are no letters; of all
    variants, longer ones first. It matches nothing if there is no variant."""
    variants = F.flatten(F.transform(names, name_variants))
    return F.when(F.size(variants) > 0, F.concat(F.lit("(?<![a-z])(?:"), F.array_join(variants, "|"), F.lit(")(?![a-z])"))).otherwise("(?!)")


_AUTHORS = ["ada byron lovelace", "jerone t. a. andrews", "li", "tsang", "marguerite", "wei x. chen", ""]
_WRITTEN = ["by ada lovelace.", "ada b. lovelace and", "adalovelace", "jerone t. a. andrews", "jerone andrews!", "by li wei", "w. chen", "wei-chen", "marguerite", "tsang", "ada-byron\nlovelace"]
# which of the texts above each name is found in
_FOUND = {0: (0, 1, 10), 1: (3, 4), 4: (8,), 5: (7,)}
_FOUND_SQL = " OR ".join(f"(s_suppkey % {len(_AUTHORS)} = {a} AND s_suppkey % {len(_WRITTEN)} IN ({', '.join(map(str, t))}))" for a, t in _FOUND.items())


def _of(options: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col("s_suppkey") % len(options) + 1).cast("int"))


@query("author_pattern_matches", f"SELECT s_suppkey, {_FOUND_SQL} AS found FROM supplier")
def author_pattern_matches(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", F.regexp_like(_of(_WRITTEN), author_pattern(F.array(_of(_AUTHORS)))).alias("found"))


@query("author_pattern_order", f"SELECT s_suppkey, CASE s_suppkey % {len(_AUTHORS)} WHEN 0 THEN 'ada,ada,ada' WHEN 1 THEN 'jerone,jerone,jerone' WHEN 4 THEN 'marguerite' WHEN 5 THEN 'wei,wei,wei' ELSE '' END AS firsts, CASE s_suppkey % {len(_AUTHORS)} WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 3 ELSE 0 END AS n FROM supplier")
def author_pattern_order(spark, d):
    """Variants of a name, the longest first (their first words are shown)."""
    variants = name_variants(_of(_AUTHORS))
    return table(spark, d, "supplier").select("s_suppkey", F.array_join(F.transform(variants, lambda v: F.regexp_extract(v, "^[a-z]+", 0)), ",").alias("firsts"), F.size(variants).alias("n"))


@query(
    "residual_names",
    """WITH n AS (SELECT doc_id AS ten, list_distinct(regexp_extract_all(min(lower(text)), '[a-z]{6,}')[1:2]) AS names FROM documents WHERE doc_id % 10 = 0 GROUP BY doc_id),
 u AS (SELECT d.doc_id, d.text, unnest(names) AS name FROM documents d JOIN n ON n.ten = d.doc_id - d.doc_id % 10)
 SELECT doc_id, count(*) AS names, string_agg(name, ',' ORDER BY name) AS found FROM u WHERE regexp_matches(lower(text), '(^|[^a-z])' || name || '([^a-z]|$)') GROUP BY doc_id""",
)
def residual_names(spark, d):
    """Names that are still in a text. Each document's names are the first long words of the first document of its ten, so
    some are found and most are not; each is a pattern of `author_pattern`."""
    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    names = docs.where("doc_id % 10 = 0").groupBy("doc_id").agg(F.min("text").alias("t")).select(F.col("doc_id").alias("ten"), F.array_distinct(F.slice(F.regexp_extract_all("t", F.lit("([a-z]{6,})"), 1), 1, 2)).alias("names"))
    both = docs.withColumn("ten", F.col("doc_id") - F.col("doc_id") % 10).join(names, "ten").select("doc_id", "text", F.explode("names").alias("name"))
    found = both.where(F.regexp_like("text", author_pattern(F.array("name"))))
    return found.groupBy("doc_id").agg(F.count("*").alias("names"), F.array_join(F.array_sort(F.collect_list("name")), ",").alias("found"))


@F.pandas_udf(T.StringType())
def repaired(values: pd.Series) -> pd.Series:
    """Text from bytes in which surrogates were written one by one: pairs become their character, single ones U+FFFD."""
    fix = lambda b: None if b is None else b.decode("utf-8", "surrogatepass").encode("utf-16", "surrogatepass").decode("utf-16", "replace")
    return values.map(fix)


@query("surrogate_repair", "SELECT doc_id, md5('x' || CASE WHEN doc_id % 3 = 0 THEN '😀' WHEN doc_id % 3 = 1 THEN '�' ELSE '' END || left(text, 50)) AS digest FROM documents")
def surrogate_repair(spark, d):
    pair, single = F.unhex(F.lit("EDA0BDEDB880")), F.unhex(F.lit("EDA0BD"))
    middle = F.when(F.col("doc_id") % 3 == 0, pair).when(F.col("doc_id") % 3 == 1, single).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode(F.lit("x"), "utf-8"), middle, F.encode(F.left("text", F.lit(50)), "utf-8"))
    return table(spark, d, "documents").select("doc_id", F.md5(repaired(raw)).alias("digest"))
