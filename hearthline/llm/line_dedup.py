"""Line deduplication by a fixed-depth tree of log templates, in DataFrame functions alone.

A line goes down the tree by its token count and its first tokens (two, or one below ``deep_from`` tokens), with tokens that
hold a digit generalised to ``<*>``. Below, its remaining tokens are cut into four segments. Lines of ``wild_from``
tokens or more fall under one template for each segment, in which it is a variable field; lines of ``two_from`` tokens or
more under one for every two segments, in which both are, so that fields may vary in two places far apart. Every line
also has the template with all tokens fixed. A template that occurs in ``min_docs`` documents or more recurs. A template
with fields needs ``field_values`` different fillings of them as well: two lines that differ in a word are no template yet. Of each
recurring template the first line stays (by doc_id, then position) and the later ones are dropped.

Templates meet by 96-bit keys, made of 64-bit hashes of the leading tokens and of each segment.

Defined results: null text counts as no lines and stays null; blank lines stay; lines of any length are parsed whole; rows
with a null doc_id stay as they are; rows that share a doc_id count as one document; a line that is first under one
template may go by another; an empty table gives no rows. Other columns pass through.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved

SEGMENTS = 4
#: Least number of fillings of a template's fields.
FIELD_VALUES = 5
#: Segments that are variable fields of a template, for lines with one field and with two.
ONE, TWO = [*combinations(range(SEGMENTS), 1)], [*combinations(range(SEGMENTS), 2)]


def line_templates(docs: DataFrame, depth: int = 2, deep_from: int = 10, wild_from: int = 4, two_from: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_doc, _at, _k1, _k2): 96-bit keys of every template that each line of the documents falls under.

    _at has the line's position in its upper 32 bits and a hash of what fills the template's fields below, 0 without fields.
    """
    lines = (
        docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("_doc"), F.posexplode(F.split(F.col(text_col), "\n")).alias("_pos", "_line"))
        .withColumn("_line", F.trim(F.regexp_replace("_line", "[\\x20\\t\\x0B\\f\\r]+", " ")))
        .where(F.col("_line") != "")
        .withColumn("_line", F.when(F.col("_line").rlike("[0-9]"), F.regexp_replace("_line", "[^ 0-9]*+[0-9][^ ]*", "<*>")).otherwise(F.col("_line")))
    )
    n, lead = F.col("_n"), F.when(F.col("_n") >= deep_from, F.lit(depth)).otherwise(F.least(F.col("_n"), F.lit(min(1, depth))))
    edge = [F.col("_d") + F.floor((n - F.col("_d")) * F.lit(i) / F.lit(SEGMENTS)).cast("int") for i in range(SEGMENTS + 1)]
    words = lines.withColumn("_w", F.split("_line", " ")).withColumn("_n", F.size("_w")).withColumn("_d", lead)
    parts = words.select(
        "_doc", "_pos", "_n", F.xxhash64(n, F.slice("_w", 1, F.col("_d"))).alias("_b"),
        *(F.xxhash64(F.slice("_w", edge[i] + 1, edge[i + 1] - edge[i])).alias(f"_h{i}") for i in range(SEGMENTS)),
    )

    def key(wild: tuple[int, ...]) -> Column:
        fixed = [F.lit(sum(1 << j for j in wild)), F.col("_b"), *(F.col(f"_h{i}") for i in range(SEGMENTS) if i not in wild)]
        filled = F.hash(*(F.col(f"_h{i}") for i in wild)).cast("long").bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseOR(F.lit(1)) if wild else F.lit(0).cast("long")
        return F.struct(F.xxhash64(*fixed).alias("k1"), F.hash(*fixed).alias("k2"), filled.alias("f"))

    of = lambda fields: F.array(key(()), *map(key, fields))
    keys = F.when(n >= two_from, of(TWO)).when(n >= wild_from, of(ONE)).otherwise(of([]))
    place = F.shiftleft(F.col("_pos").cast("long"), 32).bitwiseOR(F.col("_k.f"))
    return parts.select("_doc", "_pos", F.explode(keys).alias("_k")).select("_doc", place.alias("_at"), F.col("_k.k1").alias("_k1"), F.col("_k.k2").alias("_k2"))


def recurring_lines(docs: DataFrame, min_docs: int = 2, field_values: int = FIELD_VALUES, **options) -> DataFrame:
    """(_doc, _pos) of every line that is to go."""
    keys = line_templates(docs, **options)
    at, filled = F.struct("_doc", "_at"), F.col("_at").bitwiseAND(F.lit(0xFFFFFFFF))
    aggs = [F.min(at).alias("_first"), F.max("_doc").alias("_last")]
    if min_docs > 2:
        aggs.append(F.count_distinct("_doc").alias("_docs"))
    found = keys.groupBy("_k1", "_k2").agg(*aggs).where(F.col("_first._doc") < F.col("_last"))
    if min_docs > 2:
        found = found.where(F.col("_docs") >= min_docs)
    # of lines without fields the later ones are all that is wanted, of those with fields also the first, for its filling
    again = keys.join(found.select("_k1", "_k2", "_first"), ["_k1", "_k2"]).select("_k1", "_k2", "_doc", "_at", (at > F.col("_first")).alias("_later"), filled.alias("_f"))
    again = saved(again.where("_later or _f > 0"), "recurring-lines")
    fields = again.where("_f > 0").groupBy("_k1", "_k2", "_f").agg(F.lit(1).alias("_1")).groupBy("_k1", "_k2").agg(F.count("*").alias("_n")).where(F.col("_n") >= field_values)
    later = again.where("_later")
    gone = later.where("_f = 0").select("_doc", "_at").unionByName(later.where("_f > 0").join(saved(fields.select("_k1", "_k2"), "field-templates"), ["_k1", "_k2"], "left_semi").select("_doc", "_at"))
    return gone.select("_doc", F.shiftright("_at", 32).cast("int").alias("_pos"))


def drop_recurring_lines(docs: DataFrame, min_docs: int = 2, field_values: int = FIELD_VALUES, id_col: str = "doc_id", text_col: str = "text", counts: bool = False, **options) -> DataFrame:
    """docs with recurring lines taken out of the text; with counts, also n_lines and n_dropped. options: those of line_templates."""
    gone = recurring_lines(docs, min_docs, field_values, id_col=id_col, text_col=text_col, **options)
    gone = gone.groupBy(F.col("_doc").alias("__dedup_doc")).agg(F.collect_set("_pos").alias("__dedup_gone"))
    lines = F.split(F.col(text_col), "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("__dedup_lines") - 1), F.col("__dedup_gone")))
    text = F.when(F.col("__dedup_gone").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(F.col("__dedup_lines"), i)), "\n"))
    out = docs.join(gone, F.col(id_col) == F.col("__dedup_doc"), "left").withColumn("__dedup_lines", lines)
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        columns += [F.coalesce(F.size("__dedup_lines"), F.lit(0)).cast("long").alias("n_lines"), F.when(F.col("__dedup_gone").isNull(), 0).otherwise(F.size("__dedup_gone")).cast("long").alias("n_dropped")]
    return out.select(*columns)


def oracle_sql(depth: int = 2, deep_from: int = 10, wild_from: int = 4, two_from: int = 16) -> str:
    """The same in SQL, with templates as strings in place of hashes."""
    edges = [f"d + floor((n - d) * {i} / {SEGMENTS}.0)::int" for i in range(SEGMENTS + 1)]
    parts = [f"array_to_string(w[{edges[i]} + 1 : {edges[i + 1]}], ' ')" for i in range(SEGMENTS)]

    def some(fields: list[tuple[int, ...]]) -> str:
        text = lambda some: " || '|' || ".join(f"'{i}:' || {parts[i]}" for i in some) or "NULL"
        of = lambda wild: "{'k': concat_ws('|', '%s', n, array_to_string(w[1:d], ' '), %s), 'f': %s}" % ("".join(map(str, wild)), text([i for i in range(SEGMENTS) if i not in wild]), text(wild))
        return ", ".join(map(of, [(), *fields]))

    return f"""
WITH raw AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
l AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS pos FROM raw),
m AS (SELECT doc_id, pos, regexp_replace(trim(regexp_replace(line, '[\\x20\\t\\x0B\\f\\r]+', ' ', 'g'), ' '), '[^ ]*[0-9][^ ]*', '<*>', 'g') AS line FROM l),
t AS (SELECT *, CASE WHEN n >= {deep_from} THEN {depth} ELSE {min(1, depth)} END AS d FROM (SELECT doc_id, pos, string_split(line, ' ') AS w, len(string_split(line, ' ')) AS n FROM m WHERE line <> '')),
kf AS (SELECT doc_id, pos, unnest(CASE WHEN n >= {two_from} THEN [{some(TWO)}] WHEN n >= {wild_from} THEN [{some(ONE)}] ELSE [{some([])}] END) AS kf FROM t),
k AS (SELECT doc_id, pos, kf.k AS k, kf.f AS f FROM kf),
f AS (SELECT k, min((doc_id, pos)) AS first FROM k GROUP BY k HAVING count(DISTINCT doc_id) >= 2 AND (count(f) = 0 OR count(DISTINCT f) >= {FIELD_VALUES})),
g AS (SELECT DISTINCT k.doc_id, k.pos FROM k JOIN f USING (k) WHERE (k.doc_id, k.pos) > f.first),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE g.pos IS NULL) AS kept, count(*) AS n_lines, count(g.pos) AS n_dropped
  FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.pos = l.pos GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text, coalesce(k.n_lines, 0)::bigint AS n_lines, coalesce(k.n_dropped, 0)::bigint AS n_dropped
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id"""
