"""Benchmark decontamination by spaced seeds, in DataFrame functions alone.

Texts become lower-case runs of letters and digits. At every position each mask picks some of the next tokens and
hashes them; positions the mask skips may differ. Hashes of the benchmark meet those of the documents in a broadcast
hash join, after a semi join on the offsets that all masks share has left few positions. Where a mask also fits one position
earlier on both sides, the two lie on one diagonal, and only the first hit of such a run and every ``STEP``-th place of the item go
on, so repetitive text has about one hit a diagonal. From each hit on the tokens of both sides are compared position by
position up to the next one, and a document is contaminated
by an item if some window of ``window`` tokens (the whole item, if shorter) there agrees in ``share``
of its positions or more. With the masks below any 13 tokens with up to two substitutions have a seed in common.
Items shorter than the window get seeds of their own: cut into one run of tokens more than they may have
substitutions, some run is left whole, whatever their length.

Benchmark items are broadcast in blocks of about ``BLOCK`` tokens, so any size of benchmark is matched against all
documents with bounded memory; one block is the usual case. Seeds meet and overlaps are verified in the task that reads the
document: only verified pairs are shuffled, so neither documents nor the hits of a very common seed move.

Defined results: null ids and null or empty texts or items match nothing; texts of any length are matched whole; rows that
share an id count as one document, items that share one as one item; of several overlaps the largest number of agreeing
positions counts; empty tables give no pairs; other columns pass through, whatever their names; items of fewer than six
tokens match nothing unless ``shortest`` lets them, and then only word for word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthline.llm.common import saved, without

#: Token offsets of each mask. Together they have full sensitivity for two substitutions in 13 tokens.
MASKS = ((0, 1, 2, 3, 6, 8), (0, 1, 3, 4, 5, 7), (0, 1, 2, 3, 4, 5))
#: About the most benchmark tokens in one broadcast: some 20 MB.
BLOCK = 200_000
#: Places of an item between hits of one diagonal.
STEP = 64
#: Items of fewer tokens have no substitutions.
EXACT = 6


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), "")


def _hash(at: Column, offsets: tuple[int, ...], number: int, n: Column) -> Column:
    """Hash of the tokens at some offsets from at; null where they reach past the end."""
    return F.when(at + F.lit(offsets[-1]) < n, F.xxhash64(F.lit(number), *(F.get(F.col("_h"), at + F.lit(o)) for o in offsets)))


def _positions(df: DataFrame, key: str, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(key, _h, _at, _key) for each position of the token hashes _h at which a mask fits: hash of the offsets that all masks share."""
    common = tuple(sorted(set.intersection(*map(set, masks))))
    n, shortest = F.size("_h"), min(m[-1] for m in masks)
    at = F.explode(F.when(n > shortest, F.sequence(F.lit(0), n - F.lit(shortest + 1)))).alias("_at")
    return df.select(key, "_h", at).select(key, "_h", "_at", _hash(F.col("_at"), common, -1, n).alias("_key"))


def _by_seed(positions: DataFrame, masks: tuple[tuple[int, ...], ...], *columns: str) -> DataFrame:
    """(columns, _at, _seed, _before): one row for each mask that fits, with the mask's hash there and one position earlier, null at the start."""
    at, n = F.col("_at"), F.size("_h")
    seeds = F.array(*(F.struct(_hash(at, m, i, n).alias("s"), F.when(at > 0, _hash(at - 1, m, i, n)).alias("b")) for i, m in enumerate(masks)))
    return positions.select(*columns, "_at", F.explode(seeds).alias("_m")).where("_m.s is not null").select(*columns, "_at", F.col("_m.s").alias("_seed"), F.col("_m.b").alias("_before"))


def runs(n: int, share: float) -> list[tuple[int, int]]:
    """(start, length) of the runs that an item of n tokens is cut into: one more than it may have substitutions."""
    cut = 1 if n < EXACT else n - math.ceil(n * share) + 1
    edges = [n * i // cut for i in range(cut + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _run_hash(at: Column, length: int) -> Column:
    return F.xxhash64(F.lit(length), *(F.get(F.col("_h"), at + F.lit(o)) for o in range(length)))


def _mask_hits(items: DataFrame, texts: DataFrame, masks: tuple[tuple[int, ...], ...]) -> DataFrame:
    """(_doc, _h, _at, _item, _q) where a masked seed of an item stands in a document, for the first hit of each run on a diagonal and every STEP-th place of the item."""
    wanted = _positions(items, "_item", masks)
    near = _positions(texts, "_doc", masks).join(F.broadcast(wanted.select("_key").distinct()), "_key", "left_semi")
    seeds = _by_seed(wanted, masks, "_item").select("_item", F.col("_at").alias("_q"), F.col("_seed").alias("_seed2"), F.col("_before").alias("_before2"))
    goes_on = F.coalesce(F.col("_before") == F.col("_before2"), F.lit(False)) & (F.col("_q") % STEP != 0)
    return _by_seed(near, masks, "_doc", "_h").join(F.broadcast(seeds), (F.col("_seed") == F.col("_seed2")) & ~goes_on).select("_doc", "_h", "_at", "_item", "_q")


def _short_hits(items: DataFrame, texts: DataFrame, lengths: list[int], share: float) -> DataFrame:
    """The same where a run of an item stands in a document; items have the given numbers of tokens."""
    n = F.size("_h")
    cuts = {k: runs(k, share) for k in lengths}
    seeds = F.coalesce(*(F.when(n == k, F.array(*(F.struct(F.lit(a).alias("q"), _run_hash(F.lit(a), m).alias("seed")) for a, m in cut))) for k, cut in cuts.items()))
    wanted = items.select("_item", F.explode(seeds).alias("_r")).select("_item", F.col("_r.q").alias("_q"), F.col("_r.seed").alias("_seed"))
    sizes = sorted({m for cut in cuts.values() for _, m in cut})
    at = F.explode(F.when(n >= sizes[0], F.sequence(F.lit(0), n - F.lit(sizes[0])))).alias("_at")
    here = texts.select("_doc", "_h", at).select("_doc", "_h", "_at", F.explode(F.array(*(F.when(F.col("_at") + F.lit(m) <= n, _run_hash(F.col("_at"), m)) for m in sizes))).alias("_seed"))
    return here.join(F.broadcast(wanted), "_seed")


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", masks=MASKS, shortest: int = EXACT) -> DataFrame:
    """(id_col, item_col, matched): each document and benchmark item that share a verified overlap, and the most agreeing positions in one window."""
    hashed = lambda c: F.transform(tokens(F.col(c)), lambda t: F.xxhash64(t))
    items = benchmark.where(F.col(item_text).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).alias("_item"), hashed(item_text).alias("_h"))
    texts = docs.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_doc"), hashed(text_col).alias("_h"))
    n = F.size("_h")
    # a row for each length below the window
    short = sorted(r["n"] for r in items.where(n.between(max(1, shortest), window - 1)).select(n.alias("n")).distinct().collect())
    blocks = max(1, -(-(items.agg(F.sum(n).alias("n")).first()["n"] or 0) // BLOCK))
    if blocks > 1:
        texts = saved(texts, "token-hashes")
    reach = window + max(m[-1] for m in masks) + STEP
    found = None
    for i in range(blocks):
        some = items.where(F.pmod(F.xxhash64("_item"), F.lit(blocks)) == i) if blocks > 1 else items
        hits = [_mask_hits(some, texts, masks)] + ([_short_hits(some.where(n.isin(short)), texts, short, share)] if short else [])
        for hit in hits:
            # only the tokens around the hit go on, from a window before it to a window past the next hit
            left = F.least(F.col("_at"), F.lit(window - 1))
            hit = hit.select("_doc", "_item", "_q", left.alias("_left"), F.slice("_h", F.col("_at") - left + 1, left + F.lit(reach)).alias("_x"))
            hit = hit.join(F.broadcast(some.select("_item", F.col("_h").alias("_b"))), "_item")
            verified = _verified(hit, window, share, reach)
            found = verified if found is None else found.unionByName(verified)
    return found.groupBy("_doc", "_item").agg(F.max("_best").cast("long").alias("matched")).select(F.col("_doc").alias(id_col), F.col("_item").alias(item_col), "matched")


def _verified(hits: DataFrame, window: int, share: float, reach: int) -> DataFrame:
    """(_doc, _item, _best) of the hits around which some window agrees in enough positions. Everything here is in the task of the document."""
    before = F.least("_left", "_q")
    width = F.least(F.size("_x") - F.col("_left") + before, F.size("_b") - F.col("_q") + before, before + F.lit(reach))
    wide = F.least(F.size("_b"), F.lit(window))
    x, y = F.slice("_x", F.col("_left") - before + 1, width), F.slice("_b", F.col("_q") - before + 1, width)
    same = hits.where(width >= wide).select("_doc", "_item", wide.alias("_wide"), (F.size("_b") < EXACT).alias("_exact"), F.zip_with(x, y, lambda a, b: (a == b).cast("int")).alias("_same"))
    sums = F.transform(
        F.sequence(F.lit(0), F.size("_same") - F.col("_wide")),
        lambda i: F.aggregate(F.slice("_same", i + 1, F.col("_wide")), F.lit(0), lambda a, x: a + x),
    )
    best = same.select("_doc", "_item", "_wide", "_exact", F.array_max(sums).alias("_best"))
    return best.where(F.col("_best") >= F.when(F.col("_exact"), F.col("_wide")).otherwise(F.ceil(F.col("_wide") * F.lit(share)))).select("_doc", "_item", "_best")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """docs without those that share a verified overlap with any benchmark item; rows with a null id stay."""
    return without(docs, contaminated_pairs(docs, benchmark, id_col=id_col, **options).select(id_col).distinct(), id_col)


def oracle_sql(window: int = 13, share: float = 0.8) -> str:
    """All positions with the same token, by diagonal; no seeds."""
    toks = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id AS id, {toks} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
b AS (SELECT item_id AS id, {toks} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dt AS (SELECT id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS p FROM d),
bt AS (SELECT id, len(w) AS n, unnest(w) AS t, unnest(range(len(w))) AS q FROM b WHERE len(w) >= {EXACT}),
m AS (SELECT dt.id AS doc, bt.id AS item, p - q AS diag, q - greatest(0, q - p) AS i, least(dt.n - greatest(0, p - q), bt.n - greatest(0, q - p)) AS overlap, least(bt.n, {window}) AS wide FROM dt JOIN bt USING (t)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc, item, diag ORDER BY i RANGE BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS ahead FROM m WHERE overlap >= wide),
best AS (SELECT doc, item, diag, any_value(wide) AS wide, greatest(coalesce(max(CASE WHEN i <= overlap - wide THEN ahead END), 0), count_if(i >= overlap - wide)) AS best FROM c GROUP BY doc, item, diag)
SELECT doc AS doc_id, item AS item_id, max(best)::bigint AS matched FROM best WHERE best >= ceil(wide * {share}) GROUP BY doc, item"""
