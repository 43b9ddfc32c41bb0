"""Mixing sources to target weights, on DataFrame operations alone.

A source's weight is its token share to the power of an exponent, normalised. The exponent is
bisected in [0, max_exponent] until the weights' entropy meets the target or no source is
repeated more often than the limit allows; if both are given, the limit wins where they
differ. The target is either a share of the greatest entropy there is (``entropy_share``) or,
by default, lies ``flatten`` of the way from the shares' own entropy to the greatest, so
unequal sources are always tempered: large ones are drawn in part, small ones repeated. With
``cover`` the budget is raised until every source is drawn once at least. Each job evaluates the fifteen exponents that four halvings can reach, as sums over
the table of sources, so any number of sources is served. A source's quota, weight x budget
in tokens, is then drawn as seeded permutations of its documents, one after the other; the
last is cut where the quota ends. The draws of all sources are laid over ``blocks`` equal
blocks, so each block holds each source in proportion, and are permuted inside the block.

Edge cases: a null source is a source; null and empty texts have no tokens, get the weight of
none and are never drawn; a source alone and equal sources keep the exponent 1; repeated rows are drawn as rows of their own; an empty table, or one
without tokens, gives an empty result; further columns are ignored. A limit below
budget / tokens cannot be met: the shares themselves (exponent 1) come nearest and are used.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import cut, free_name, prefix, row_keys, table

HALVINGS, AT_ONCE = 24, 4


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keys: tuple[str, ...] = ()) -> DataFrame:
    """(id, source, n_tokens, check, *keys): tokens are runs of anything but ASCII white space."""
    words = F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select(
        F.col(id_col),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("source"),
        F.coalesce(words, F.lit(0)).cast("long").alias("n_tokens"),
        F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary")).alias("check"),
        *keys,
    )


def _midpoints(low: float, high: float, depth: int) -> list[float]:
    mid = (low + high) / 2
    return [mid] if depth == 1 else [mid, *_midpoints(low, mid, depth - 1), *_midpoints(mid, high, depth - 1)]


def fit_exponent(sizes: DataFrame, total: int, too_flat, max_exponent: float) -> float:
    """Bisect the exponent: ``too_flat(exponent, z, s, n, least)`` says whether it must rise,
    with z = sum(p^a), s = sum(p^a ln p), and the smallest p of the n sources."""
    p = F.col("tokens") / F.lit(float(total))
    low, high = 0.0, max_exponent
    for _ in range(HALVINGS // AT_ONCE):
        tried = _midpoints(low, high, AT_ONCE)
        sums = [F.count(F.lit(1)), F.min(p)]
        for a in tried:
            sums += [F.sum(F.pow(p, F.lit(a))), F.sum(F.pow(p, F.lit(a)) * F.log(p))]
        n, least, *rest = sizes.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()
        known = {a: (rest[2 * i], rest[2 * i + 1]) for i, a in enumerate(tried)}
        for _ in range(AT_ONCE):
            mid = (low + high) / 2
            if too_flat(mid, *known[mid], n, least):
                low = mid
            else:
                high = mid
    return high


def source_weights(
    counts: DataFrame,
    budget: int | None,
    entropy_share: float | None,
    max_repeats: float | None,
    max_exponent: float = 1.0,
    flatten: float | None = None,
    cover: bool = False,
) -> tuple[DataFrame, int]:
    """(source, docs, tokens, exponent, weight, quota) and the budget in tokens."""
    sizes = cut(
        counts.where("n_tokens > 0").groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens")), "sources"
    )
    t = F.col("tokens")
    total, n, t_log_t, least, most = sizes.agg(
        F.coalesce(F.sum(t), F.lit(0)), F.count(F.lit(1)), F.sum(t * F.log(t)), F.min(t), F.max(t)
    ).first()
    budget = total if budget is None else budget
    exponent, target = 1.0, None
    if total and n > 1 and least < most:
        own = math.log(total) - t_log_t / total
        target = entropy_share * math.log(n) if entropy_share is not None else None if flatten is None else own + flatten * (math.log(n) - own)
    if target is not None:
        flat = lambda a, z, s, *_: math.log(z) - a * s / z > target
        exponent = fit_exponent(sizes, total, flat, max_exponent)
    if total and n > 1 and least < most and max_repeats is not None:
        over = lambda a, z, s, n, least: budget / total * least ** (a - 1) / z > max_repeats
        exponent = max(exponent if target is not None else 0.0, fit_exponent(sizes, total, over, 1.0))
    exponent = round(exponent, 6)
    power = F.pow(F.col("tokens") / F.lit(float(max(total, 1))), F.lit(exponent))
    norm = sizes.agg(F.sum(power)).first()[0]
    weight = F.round(power / F.lit(norm or 1.0), 9)
    out = sizes.select("source", "docs", "tokens", F.lit(exponent).alias("exponent"), weight.alias("weight"))
    if cover and total:
        budget = max(budget, math.ceil(out.agg(F.max(t / F.col("weight"))).first()[0]))
    quota = F.floor(F.col("weight") * budget)
    return out.withColumn("quota", F.greatest(quota, t) if cover else quota), budget


def mix(
    docs: DataFrame,
    budget: int | None = None,
    entropy_share: float | None = None,
    max_repeats: float | None = 4.0,
    blocks: int = 64,
    seed: int = 0,
    max_exponent: float = 1.0,
    flatten: float | None = 0.5,
    cover: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    keys: tuple[str, ...] = (),
) -> DataFrame:
    """One row a draw: id, source, check, n_tokens, epoch, block, weight, exponent, and
    ``turn``, the hash that orders the draws of a block, and the columns ``keys`` of the drawn
    row. ``budget`` None: as many tokens as there are."""
    counts = cut(token_counts(docs, id_col, text_col, source_col, keys), "counts")
    weights, _ = source_weights(counts, budget, entropy_share, max_repeats, max_exponent, flatten, cover)
    weights = cut(weights, "weights")
    need = weights.withColumn("passes", F.ceil(F.col("quota") / F.col("tokens")).cast("int"))
    draws = (
        counts.where("n_tokens > 0")
        .join(need, "source")
        .withColumn("epoch", F.explode(F.expr("sequence(0, greatest(passes, 1) - 1)")))
        .withColumn("turn", F.xxhash64(F.col(id_col), "check", "epoch", F.lit(seed)))
    )
    ranked = prefix(draws, ["source", "epoch"], ["turn", id_col, "check"], weight="n_tokens", before="_before", rows=counts.count())
    at = F.col("epoch") * F.col("tokens") + F.col("_before")
    kept = ranked.withColumn("_at", at).where(F.col("_at") < F.col("quota"))
    block = F.least(F.floor(F.col("_at") * blocks / F.col("quota")), F.lit(blocks - 1)).cast("int")
    source = F.expr("CASE WHEN source = '' THEN NULL ELSE substring(source, 2) END")
    return kept.select(
        id_col, source.alias(source_col), "check", "n_tokens", "epoch", block.alias("block"), "turn", "weight", "exponent", *keys
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``docs`` as often as they are drawn, in the order of the mixture (block by
    block). Rows without an id have draws of their own; so has each of several equal rows."""
    rows, keys = row_keys(docs)
    drawn = mix(rows, id_col=id_col, text_col=text_col, source_col=source_col, keys=keys, **options)
    block, turn = free_name(rows, "_block"), free_name(rows, "_turn")
    drawn = drawn.select(*keys, F.col("block").alias(block), F.col("turn").alias(turn))
    return rows.dropDuplicates(list(keys)).join(drawn, list(keys)).orderBy(block, turn).select(*docs.columns)


def op1_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))
