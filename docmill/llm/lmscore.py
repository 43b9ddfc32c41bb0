"""Cross-entropy difference scores from matched bigram models.

A target model (texts of the wanted kind) and a background model (all documents) have the
same order, smoothing and vocabulary (the V distinct words of both corpora). Bigrams fall back
on words, and words on the uniform distribution:
p(w | h) = (count(h w) + m p(w)) / (count(h) + m),  p(w) = (count(w) + a) / (tokens + a V).
A document's score is the mean over its tokens of target loss minus background loss; lower is
nearer to the target.

Tasks cut the documents into packets and sum each packet's words and bigrams: a key goes out
once a packet, however often it occurs there, as the step from the next smaller key (six bytes
tell 64 bits). Ranges of keys are buckets; a bucket adds the packets' counts up and answers each
packet with the corpus's counts of its keys, in their order, so answers need no keys. A second
pass makes the same packets again, with a number for each word, and scores them where the
answers arrive; a packet's name is a hash of its content, so documents that change between the
passes are an error, not a wrong score. What is gathered are the counts of every word and bigram
of the corpus; a key costs a task at most one entry a packet, so no common word makes a group of
its own. A document's own words count in the background like all others.

Edge cases: null, empty and word-less texts have no tokens and null losses; repeated rows are
scored as rows and count as often as they come; with no target text the target model is
uniform; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm._common import WordHashes, cut, table

START, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Packet:
    """The distinct keys of some documents, from their words' hashes and the words' numbers at
    each token: ``keys`` holds the words and then the bigrams, ``first`` and ``second`` the words
    of each bigram (a first of -1: the document's beginning), ``at`` the bigram at each token."""

    def __init__(self, words: np.ndarray, numbers: np.ndarray, sizes: np.ndarray):
        n = self.n_words = len(words)
        before = np.empty_like(numbers)
        if n:
            before[1:] = numbers[:-1]
            before[(np.cumsum(sizes) - sizes)[sizes > 0]] = -1
        pairs, self.at = np.unique((before + 1) * np.int64(max(1, n)) + numbers, return_inverse=True)
        self.first, self.second = pairs // max(1, n) - 1, pairs % max(1, n)
        h = np.where(self.first < 0, START, words[np.maximum(self.first, 0)] if n else START)
        mixed = (h * MIX) ^ (words[self.second] + (h >> np.uint64(29)))
        mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
        self.keys = np.concatenate([words, mixed ^ (mixed >> np.uint64(32))])
        # words and bigrams have buckets of their own
        self.order = np.concatenate([np.argsort(words), n + np.argsort(self.keys[n:])])

    def buckets(self, n: int) -> np.ndarray:
        """The buckets of the keys in their order, ascending."""
        bucket = ((self.keys[self.order] >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
        bucket[self.n_words :] += n
        return bucket


def _runs(at: np.ndarray):
    edge = np.flatnonzero(np.diff(at, prepend=-9)).tolist()
    return zip(edge, [*edge[1:], len(at)][: len(edge)], strict=True)


ESCAPE = np.uint64((1 << 48) - 1)


def steps(keys: np.ndarray) -> bytes:
    """Ascending keys as differences: six bytes each, and eight more for those that need them."""
    gap = np.diff(keys, prepend=np.uint64(0))
    low = np.minimum(gap, ESCAPE).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
    return low.tobytes() + gap[gap >= ESCAPE].astype("<u8").tobytes()


def walked(raw: bytes, n: int) -> np.ndarray:
    low = np.zeros((n, 8), np.uint8)
    low[:, :6] = np.frombuffer(raw, np.uint8, 6 * n).reshape(n, 6)
    gap = low.view("<u8").ravel().astype(np.uint64)
    if len(raw) > 6 * n:
        gap[gap == ESCAPE] = np.frombuffer(raw, "<u8", -1, 6 * n)
    return np.cumsum(gap, dtype=np.uint64)


def small(counts: np.ndarray) -> bytes:
    """Counts as bytes: one each, and eight more for those of 255 and over."""
    large = counts >= 255
    return np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes()


def wide(raw: bytes, n: int) -> np.ndarray:
    """The ``n`` counts of ``small``; no bytes: zeros."""
    out = np.zeros(n, np.int64)
    if raw:
        out[:] = np.frombuffer(raw, np.uint8, n)
        if len(raw) > n:
            out[out == 255] = np.frombuffer(raw, "<u8", -1, n).astype(np.int64)
    return out


def chunks(sizes: list[int], most_rows: int, most: int):
    """(first, end) of runs of rows, each within both limits or a single row."""
    lo = total = 0
    for k, size in enumerate(sizes):
        if k > lo and (total + size > most or k - lo == most_rows):
            yield lo, k
            lo, total = k, 0
        total += size
    yield lo, len(sizes)


SENT = "bucket long, packet long, n long, keys binary, ct binary, cb binary"
REPLY = "packet long, bucket long, n long, ct binary, cb binary, v long, tokens_t long, tokens_b long"
HEAD = "packet long, ids array<{0}>, sizes binary, real binary, words binary, numbers binary"


def packets(batches, packet_docs: int, packet_words: int):
    """(name, ids, whether each is a document, sizes, words, numbers, Packet): the same for the
    same batches, whichever task makes them."""
    hashes = WordHashes()
    for b in batches:
        made = [hashes(t) for t in b["_text"]]
        for lo, end in chunks(list(map(len, made)), packet_docs, packet_words) if made else ():
            own = b["_own"].iloc[lo:end].to_numpy(bool)
            sizes = np.fromiter(map(len, made[lo:end]), np.int64, end - lo)
            words, numbers, times = np.unique(np.concatenate(made[lo:end]), return_inverse=True, return_counts=True)
            place = np.argsort(-times, kind="stable")  # common words get small numbers
            words, numbers = words[place], np.argsort(place)[numbers]
            name = xxhash.xxh64(words.tobytes() + numbers.tobytes() + sizes.tobytes() + own.tobytes()).intdigest()
            p = Packet(words, numbers, sizes)
            made[lo:end] = [None] * (end - lo)
            yield int(np.uint64(name).view(np.int64)), b["_id"].iloc[lo:end], own, sizes, words, numbers, p


def score_documents(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    a: float = 0.01,
    m: float = 4.0,
    packet_docs: int = 10_000,
    packet_words: int = 600_000,
    bucket_bytes: int = 8_000_000,
    least_buckets: int = 64,
) -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every document; ``target`` holds
    the target texts (column ``text_col``). There is a bucket for every ``bucket_bytes`` of text."""
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col).alias("_text")
    rows = docs.select(F.col(id_col).alias("_id"), text, F.lit(0).alias("_own")).unionByName(
        target.select(F.lit(None).cast(kind).alias("_id"), text, F.lit(1).alias("_own"))
    )
    begins = F.when(F.col("_text").rlike(r"[^\x20\x09-\x0D]"), F.col("_own"))
    begun_t, begun_all, n_bytes = rows.agg(F.sum(begins), F.count(begins), F.sum(F.octet_length("_text"))).first()
    begun = (begun_t or 0, begun_all - (begun_t or 0))
    buckets = max(least_buckets, -(-(n_bytes or 0) // bucket_bytes))
    sent, answer, heads = ([c.split()[0] for c in shape.split(", ")] for shape in (SENT, REPLY, HEAD))

    def send(batches):
        for name, _, own, sizes, words, numbers, p in packets(batches, packet_docs, packet_words):
            goal, out = np.repeat(own, sizes), []
            ct, cb = (np.concatenate([np.bincount(x[w], minlength=n) for x, n in ((numbers, len(words)), (p.at, len(p.first)))]) for w in (goal, ~goal))
            for i, j in _runs(bucket := p.buckets(buckets)):
                at = p.order[i:j]
                out.append([int(bucket[i]), name, j - i, steps(p.keys[at]), small(ct[at]) if ct[at].any() else b"", small(cb[at])])
            yield pd.DataFrame(out, columns=sent)

    def add_up(key, pdf):
        sizes = pdf["n"].tolist()
        each, back = np.unique(np.concatenate(list(map(walked, pdf["keys"], sizes))), return_inverse=True)
        ct, cb = (np.bincount(back, np.concatenate(list(map(wide, pdf[c], sizes))), len(each)).astype(np.int64) for c in ("ct", "cb"))
        out, at = [], 0
        for packet, n in zip(pdf["packet"], sizes, strict=True):
            own = back[at : at + n]
            # the words' sums come once, with the bucket's first answer
            sums = (len(each), int(ct.sum()), int(cb.sum())) if key[0] < buckets and not at else (0, 0, 0)
            out.append([packet, key[0], n, small(ct[own]) if ct[own].any() else b"", small(cb[own]), *sums])
            at += n
        return pd.DataFrame(out, columns=answer)

    def again(batches):
        squeeze = lambda x: pa.compress(x, "zstd", asbytes=True)
        for name, ids, own, sizes, words, numbers, _ in packets(batches, packet_docs, packet_words):
            halves = (numbers & 0xFFFF).astype("<u2").tobytes() + (numbers >> 16).astype("<u2").tobytes()
            one = [name, ids.tolist(), sizes.astype("<u4").tobytes(), (~own).tobytes(), words.astype("<u8").tobytes(), squeeze(halves)]
            yield pd.DataFrame([one], columns=heads)

    replies = cut(rows.mapInPandas(send, SENT).groupBy("bucket").applyInPandas(add_up, REPLY), "counts")
    v, *tokens = replies.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("v", "tokens_t", "tokens_b")]).first()

    def score(pdf):
        made, rest = pdf[pdf["sizes"].notna()], pdf[pdf["sizes"].isna()].drop_duplicates("bucket").sort_values("bucket")
        if not len(made):
            raise RuntimeError("the documents changed while they were scored")
        head = made.iloc[0]  # packets of one name differ in ids alone
        sizes, real = np.frombuffer(head["sizes"], "<u4").astype(np.int64), np.frombuffer(head["real"], bool)
        n = int(sizes.sum())
        low, high = np.frombuffer(pa.decompress(head["numbers"], 4 * n, "zstd", asbytes=True), "<u2").astype(np.int64).reshape(2, n)
        numbers, doc = low | high << 16, np.repeat(np.arange(len(sizes)), sizes)
        p, total = Packet(np.frombuffer(head["words"], "<u8"), numbers, sizes), np.zeros((2, len(sizes)))
        if int(rest["n"].sum()) != len(p.keys):
            raise RuntimeError("the documents changed while they were scored")
        for k, c in enumerate(("ct", "cb") if n else ()):
            counts = np.zeros(len(p.keys))
            counts[p.order] = np.concatenate([wide(x, int(size)) for x, size in zip(rest[c], rest["n"], strict=True)])
            one, two = counts[: p.n_words], counts[p.n_words :]
            before = np.where(p.first < 0, begun[k], one[p.first])
            loss = np.log(before + m) - np.log(two + m * (one[p.second] + a) / (tokens[k] + a * v))
            total[k] = np.bincount(doc, loss[p.at], len(sizes))
        with np.errstate(all="ignore"):
            mean = np.where(sizes > 0, total / sizes, np.nan)[:, real]
        each = [pd.DataFrame({"_id": pd.Series(list(ids), dtype=object)[real].to_numpy(), "n_tokens": sizes[real], "t": mean[0], "b": mean[1]}) for ids in made["ids"]]
        return pd.concat(each)

    parts = rows.mapInPandas(again, HEAD.format(kind)).unionByName(replies.drop("v", "tokens_t", "tokens_b"), allowMissingColumns=True)
    scored = parts.groupBy("packet").applyInPandas(score, f"_id {kind}, n_tokens long, t double, b double")
    loss = lambda c: F.when(F.col("n_tokens") > 0, F.col(c))
    return scored.select(
        F.col("_id").alias(id_col), "n_tokens", loss("t").alias("target_loss"), loss("b").alias("background_loss"),
        (loss("t") - loss("b")).alias("score"),
    )


def op10_lm_score(spark, sf_dir):
    scored = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    six = [F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "score")]
    return scored.select("doc_id", "n_tokens", *six)
