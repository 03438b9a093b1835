"""Mixing sources to target weights by Sainte-Lague apportionment.

Documents are dealt to shards by a hash of their id and, within a shard and
source, laid end to end in hash order and cut into blocks of ``block_tokens``
words (the last one may be shorter); a block may begin and end inside a
document, so that all are of equal tokens.  ``budget_share`` of all blocks is apportioned to sources by
the highest quotients weight / (2k + 1), k = 0, 1, ..., a source getting no
more blocks than it has; each source's blocks are apportioned to its shards in
the same way, by the blocks they hold.  Within a shard and source, blocks are
chosen in the order of a seeded hash.

Weights are integers by source; the default is the rounded-down square root of
a source's words, which damps large sources.

Defined results: a null source is the source "(none)"; null and empty texts
have 0 words and go with the block of the word before them; a document longer
than a block has a piece in each of several; equal quotients go to the source
(or shard) first in order; rows with equal ids share a shard and keep their own
place in it; a source without weight gets nothing; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, within

BLOCK_TOKENS = 4096
SHARD_TOKENS = 8_000_000
BUDGET_SHARE = 0.8
SEED = 17


def words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def _hash(*parts: Column | str) -> Column:
    return F.md5(F.concat_ws(":", *parts))


def apportion(weights: dict[str, int], available: dict[str, int], seats: int) -> dict[str, int]:
    """Sainte-Lague seats by source, at most ``available`` each.

    All quotients of at least 1/x are given at once, with the largest x that
    does not give too many; what remains, less than one seat a source or so,
    goes one by one.  Exact for integer weights of any size.
    """
    seats = min(seats, sum(n for s, n in available.items() if weights.get(s, 0) > 0))
    names = sorted(s for s in available if weights.get(s, 0) > 0 and available[s] > 0)

    def given(x: Fraction) -> dict[str, int]:
        return {s: min(available[s], math.floor((weights[s] * x + 1) / 2)) for s in names}

    low, high = Fraction(0), Fraction(1)
    while names and sum(given(high).values()) < seats:
        high *= 2
    for _ in range(64):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(given(mid).values()) <= seats else (low, mid)
    out = given(low)
    heap = [(Fraction(2 * out[s] + 1, weights[s]), s) for s in names if out[s] < available[s]]
    heapq.heapify(heap)
    for _ in range(seats - sum(out.values())):
        _, s = heapq.heappop(heap)
        out[s] += 1
        if out[s] < available[s]:
            heapq.heappush(heap, (Fraction(2 * out[s] + 1, weights[s]), s))
    return out


RESULT = ["doc_id", "source", "shard", "block", "start_word", "n_words", "quota"]


def mix(
    docs: DataFrame,
    weights: dict[str, int] | None = None,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    budget_share: float = BUDGET_SHARE,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
) -> DataFrame:
    """The pieces of documents in chosen blocks, with the quota of their source in the shard."""
    return _mix(docs, weights, block_tokens, shard_tokens, budget_share, seed, id_col, source_col, text_col).select(*RESULT)


def _row(*columns: str) -> Column:
    return F.xxhash64(*columns)


def _mix(docs: DataFrame, weights: dict[str, int] | None, block_tokens: int, shard_tokens: int, budget_share: float, seed: int, id_col: str, source_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    d = docs.select(_row(id_col, source_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col), F.lit("(none)")).alias("source"), words(text_col).alias("n_words"))
    d = checkpoint(d.withColumn("h", _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(str(seed)))))
    total = d.agg(F.sum("n_words")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    dealt = d.withColumn("shard", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(shards)))
    placed = spark.sql(
        f"""WITH c AS (SELECT row, doc_id, source, shard, n_words, CAST(sum(n_words) OVER (PARTITION BY source, shard ORDER BY h, doc_id, n_words ROWS UNBOUNDED PRECEDING) - n_words AS BIGINT) AS before FROM {{dealt}}),
            p AS (SELECT *, explode(CASE WHEN n_words > 0 THEN sequence(before DIV {block_tokens}, (before + n_words - 1) DIV {block_tokens}) ELSE array(greatest(0L, before - 1) DIV {block_tokens}) END) AS block FROM c)
        SELECT row, doc_id, source, shard, block, greatest(0L, block * {block_tokens} - before) AS start_word,
            CASE WHEN n_words > 0 THEN least((block + 1) * {block_tokens}, before + n_words) - greatest(block * {block_tokens}, before) ELSE 0L END AS n_words FROM p""",
        dealt=dealt,
    )
    blocks = checkpoint(placed.groupBy("source", "shard", "block").agg(F.sum("n_words").alias("n_words")))
    # one row a source: the driver apportions these, whatever the size of the corpus
    stat = {r["source"]: r for r in blocks.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_words").alias("words")).collect()}
    w = {s: math.isqrt(r["words"]) for s, r in stat.items()} if weights is None else weights
    have = {s: r["n"] for s, r in stat.items()}
    seats = apportion(w, have, math.floor(sum(have.values()) * budget_share))
    quota = spark.createDataFrame([(s, n) for s, n in seats.items()], "source string, seats long")
    by_shard = blocks.groupBy("source", "shard").agg(F.count("*").alias("n"))
    quotas = spark.sql(
        """WITH q AS (SELECT source, shard, seats, n / (2D * k + 1) AS quotient, k FROM {by_shard} LATERAL VIEW explode(sequence(0L, n - 1)) AS k),
        r AS (SELECT source, shard, seats, row_number() OVER (PARTITION BY source ORDER BY quotient DESC, shard, k) AS place FROM q)
        SELECT source, shard, count(*) AS quota FROM r WHERE place <= seats GROUP BY source, shard""",
        by_shard=by_shard.join(quota, "source"),
    )
    ranked = blocks.select("source", "shard", "block").withColumn("b", _hash("source", F.col("shard").cast("string"), F.col("block").cast("string"), F.lit(str(seed))))
    ranked = ranked.selectExpr("source", "shard", "block", "row_number() OVER (PARTITION BY source, shard ORDER BY b, block) AS place")
    chosen = ranked.join(quotas, ["source", "shard"]).where("place <= quota").select("source", "shard", "block", "quota")
    return placed.join(chosen, ["source", "shard", "block"])


def mixed_documents(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, budget_share: float = BUDGET_SHARE, seed: int = SEED, weights: dict[str, int] | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The documents whose first word lies in a chosen block, whole, with all their columns; rows of equal id, source and text stay or go together, null ids like others."""
    first = _mix(docs, weights, block_tokens, shard_tokens, budget_share, seed, id_col, source_col, text_col).where("start_word = 0")
    chosen = checkpoint(first.select(F.col("row").alias("__row")).distinct())
    return within(docs.withColumn("__row", _row(id_col, source_col, text_col)), chosen, "__row").select(docs.columns)


def oracle(block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, budget_share: float = BUDGET_SHARE, seed: int = SEED) -> str:
    """The same by ranking all quotients, in DuckDB's SQL."""
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '(none)') AS source, CAST(coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0) AS BIGINT) AS n_words, md5(doc_id || ':{seed}') AS h FROM documents),
t AS (SELECT greatest(1, CAST(ceil(coalesce(sum(n_words), 0) / {shard_tokens}) AS BIGINT)) AS shards FROM d),
s AS (SELECT d.*, CAST('0x' || substr(h, 1, 8) AS BIGINT) % shards AS shard FROM d, t),
e AS (SELECT *, CAST(sum(n_words) OVER (PARTITION BY source, shard ORDER BY h, doc_id, n_words ROWS UNBOUNDED PRECEDING) - n_words AS BIGINT) AS before FROM s),
i AS (SELECT *, unnest(CASE WHEN n_words > 0 THEN range(before // {block_tokens}, (before + n_words - 1) // {block_tokens} + 1) ELSE [greatest(0, before - 1) // {block_tokens}] END) AS block FROM e),
p AS (SELECT doc_id, source, shard, block, greatest(0, block * {block_tokens} - before) AS start_word,
  CASE WHEN n_words > 0 THEN least((block + 1) * {block_tokens}, before + n_words) - greatest(block * {block_tokens}, before) ELSE 0 END AS n_words FROM i),
b AS (SELECT source, shard, block, sum(n_words) AS n_words FROM p GROUP BY ALL),
w AS (SELECT source, count(*) AS n, CAST(floor(sqrt(sum(n_words))) AS BIGINT) AS weight FROM b GROUP BY source),
q AS (SELECT source, row_number() OVER (ORDER BY weight / (2.0::DOUBLE * k + 1) DESC, source, k) AS place FROM (SELECT *, unnest(range(n)) AS k FROM w) WHERE weight > 0),
a AS (SELECT source, count(*) AS seats FROM q WHERE place <= (SELECT floor(count(*) * {budget_share}::DOUBLE) FROM b) GROUP BY source),
z AS (SELECT source, shard, count(*) AS n FROM b GROUP BY ALL),
r AS (SELECT source, shard, row_number() OVER (PARTITION BY source ORDER BY n / (2.0::DOUBLE * k + 1) DESC, shard, k) AS place FROM (SELECT *, unnest(range(n)) AS k FROM z)),
u AS (SELECT source, shard, count(*) AS quota FROM r JOIN a USING (source) WHERE place <= seats GROUP BY ALL),
c AS (SELECT source, shard, block, row_number() OVER (PARTITION BY source, shard ORDER BY md5(source || ':' || shard || ':' || block || ':{seed}'), block) AS place FROM b)
SELECT doc_id, p.source, p.shard, p.block, p.start_word, p.n_words, quota FROM p JOIN c ON p.source = c.source AND p.shard = c.shard AND p.block = c.block JOIN u ON u.source = p.source AND u.shard = p.shard WHERE place <= quota"""
