"""Best-fit packing of token sequences by minimum bin slack.

Only lengths matter to a bin, and there are at most ``capacity`` of them, so the driver plans
on the histogram of lengths, whose size the capacity bounds. For each bin a bitset
subset-sum programme over the lengths still there, led by the largest one, finds the fullest
combination; it is removed, at once as often as its lengths last. Pieces take the planned places
by their rank within their length: the place in the task that made them, plus the pieces of that
length in the tasks before, so pieces and their token ids stay where they are.

Edge cases: null and empty texts are one end token; texts longer than the capacity are cut
into full pieces and a rest; repeated rows and ids are packed as often as they come; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import string
from bisect import bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docmill.llm._common import cut, held, lean, small_batches, table

CACHED_WORDS, CACHED_CHARS, LINE_WORDS = 150_000, 40, 64
SEPARATOR, PUNCTUATION = "~", string.punctuation.encode()


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of a text as little-endian unsigned 32-bit bytes. A tokenizer that drops white space
    and never joins over it encodes each distinct word once, and texts are lookups; any other
    encodes whole texts. About twice ``cached_words`` words used lately are
    remembered, in two generations."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer, self.known, self.older = Tokenizer.from_file(path), {}, {}
        self.cached_words = cached_words
        one, two, mark = self._ids(["word", "other", SEPARATOR])
        self.by_word = self._ids([" word \n\tother\r"]) == [one + two] and len(mark) == 4
        self.mark = np.frombuffer(mark, "<u4")[0]
        vocabulary, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if suffix and t.endswith(suffix)]] = True
        signs = [*PUNCTUATION.decode(), PUNCTUATION.decode()]
        parted = self._ids([f"other{s}" for s in signs]) == [two + s for s in self._ids(signs)]
        self.has_ends = bool(parted and self.ends.any())

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> list[bytes]:
        """Encodes lines of words with a mark between them; where a word holds the mark's id
        there are too many marks, and the line's words are encoded one by one."""
        lines = [words[i : i + LINE_WORDS] for i in range(0, len(words), LINE_WORDS)]
        gap, out = f" {SEPARATOR} ".encode(), []
        for line, coded in zip(lines, self._ids([gap.join(x).decode() for x in lines]), strict=True):
            marks = np.flatnonzero(np.frombuffer(coded, "<u4") == self.mark)
            if len(marks) == len(line) - 1:
                ends = (4 * marks).tolist()
                out += [coded[a:b] for a, b in zip([0, *(e + 4 for e in ends)], [*ends, len(coded)], strict=True)]
            else:
                out += self._ids([w.decode() for w in line])
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Adds words to the known ones. Letters, or letters and punctuation after them, need no
        marks if the vocabulary tells which ids end a run of either: a word has one or two ends.
        A line with more or fewer ends than that is encoded with marks."""
        known, plain, sizes, others = self.known, [], [], []
        for w in words:
            letters = w.rstrip(PUNCTUATION)
            if self.has_ends and (letters.isalpha() or letters.decode().isalpha()):
                plain.append(w)
                sizes.append(1 if len(letters) == len(w) else 2)
            else:
                others.append(w)
        lines = [plain[i : i + LINE_WORDS] for i in range(0, len(plain), LINE_WORDS)]
        for k, (line, coded) in enumerate(zip(lines, self._ids([b" ".join(x).decode() for x in lines]), strict=True)):
            last = np.cumsum(sizes[k * LINE_WORDS : k * LINE_WORDS + len(line)])
            ends = 4 * np.flatnonzero(self.ends[np.frombuffer(coded, "<u4")]) + 4
            if len(ends) == last[-1] and ends[-1] == len(coded):
                stops = ends[last - 1].tolist()
                known.update((w, coded[a:b]) for w, a, b in zip(line, [0, *stops], stops))  # noqa: B905
            else:
                others += line
        known.update(zip(others, self._words(others), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        if not self.by_word:
            return self._ids([(t or "").encode("utf-8", "replace").decode() for t in texts])
        split = [(t or "").encode("utf-8", "replace").split() for t in texts]
        if len(self.known) > self.cached_words:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        missing = set().union(*split).difference(known)
        seen = missing.intersection(older)
        known.update((w, older[w]) for w in seen)
        new = list(missing - seen)
        for i in range(0, len(new), 20_000):
            self._learn(new[i : i + 20_000])
        made = [b"".join(map(known.__getitem__, words)) for words in split]
        for w in new:
            if len(w) > CACHED_CHARS:
                del known[w]
        return made


def encoder(path: str, cached_words: int = CACHED_WORDS) -> WordEncoder:
    """One for each Python worker, until it turns to other work."""
    return held(("encoder", path, cached_words), lambda: WordEncoder(path, cached_words))


def pieces(
    docs: DataFrame,
    tokenizer: str | None = None,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    batch_chars: int = 4_000_000,
    cached_words: int = CACHED_WORDS,
    spare: bool = False,
) -> DataFrame:
    """(id, piece, start, length, ids, part, nth): each document's ids and ``end_id``, cut at
    ``capacity``; ``ids`` are little-endian unsigned 32-bit bytes. ``part`` is the task, and
    ``nth`` counts its pieces of a length, so the pieces must be written before they are packed.
    ``spare``: workers give memory back after each batch."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer or public_tokenizer(), cached_words)
        part_id, seen = TaskContext.get().partitionId(), Counter()
        for b in batches:
            ids, texts = b["_id"].tolist(), b["_text"].tolist()
            at = 0
            while at < len(ids):
                stop, size = at, 0
                while stop < len(ids) and (stop == at or size < batch_chars):
                    size += len(texts[stop] or "")
                    stop += 1
                out = []
                for i, coded in zip(ids[at:stop], encode(texts[at:stop]), strict=True):
                    coded += end
                    for k, s in enumerate(range(0, len(coded), 4 * capacity)):
                        part = coded[s : s + 4 * capacity]
                        length = len(part) // 4
                        out.append((i, k, s // 4, length, part, part_id, seen[length]))
                        seen[length] += 1
                frame = pd.DataFrame(out, columns=["_id", "piece", "start", "length", "ids", "part", "nth"])
                frame["_id"] = frame["_id"].astype(object if frame["_id"].isna().any() else b["_id"].dtype)
                yield frame
                at = stop

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    shape = f"_id {kind}, piece int, start long, length long, ids binary, part int, nth long"
    return rows.mapInPandas(lean(run) if spare else run, shape).withColumnRenamed("_id", id_col)


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """Lengths and how often each, the sum as near below ``room`` as any choice comes."""
    reach, steps, mask = 1, [], (1 << (room + 1)) - 1
    for length in reversed(lengths[: bisect_right(lengths, room)]):
        for _ in range(min(counts[length], room // length)):
            more = (reach | reach << length) & mask
            if more == reach:
                break
            steps.append((length, reach))
            reach = more
            if reach >> room:
                break
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] = chosen.get(length, 0) + 1
            at -= length
    return chosen


def plan_bins(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(how many bins, {length: times in each}) until no piece is left."""
    counts = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(counts)
    plan = []
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        bin_ = fullest(lengths, counts, capacity - seed)
        counts[seed] += 1
        bin_[seed] = bin_.get(seed, 0) + 1
        times = min(counts[k] // m for k, m in bin_.items())
        for k, m in bin_.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
                lengths.remove(k)
        plan.append((times, bin_))
    return plan


def places(plan: list[tuple[int, dict[int, int]]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times in a bin, first bin, first offset), by first rank."""
    used: dict[int, int] = {}
    rows: dict[int, list] = {}
    first = 0
    for times, bin_ in plan:
        offset = 0
        for length, m in sorted(bin_.items(), reverse=True):
            rows.setdefault(length, []).append((used.get(length, 0), m, first, offset))
            used[length] = used.get(length, 0) + m * times
            offset += m * length
        first += times
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut_pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``cut_pieces`` (written; length, part, nth and any other columns) with sequence_id and
    offset instead of part and nth; sequences hold at most ``capacity`` tokens."""
    counts = cut(cut_pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    place = places(plan_bins(histogram, capacity))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(counts.select("length", "part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_before")), "starts")

    @F.pandas_udf("sequence_id long, offset long")
    def placed(lengths: pd.Series, ranks: pd.Series) -> pd.DataFrame:
        length, rank = lengths.to_numpy(), ranks.to_numpy()
        sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for k in np.unique(length):
            own = np.flatnonzero(length == k)
            at = place[k][np.searchsorted(place[k][:, 0], rank[own], "right") - 1]
            turn = rank[own] - at[:, 0]
            sequence[own] = at[:, 2] + turn // at[:, 1]
            offset[own] = at[:, 3] + turn % at[:, 1] * k
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    out = cut_pieces.join(starts, ["length", "part"]).withColumn("_place", placed("length", F.col("_before") + F.col("nth")))
    kept = [c for c in cut_pieces.columns if c not in ("part", "nth")]
    return out.select(*kept, "_place.sequence_id", "_place.offset")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, **names) -> DataFrame:
    """Every document's pieces, their ids' crc32 and their places in sequences of at most ``capacity`` tokens."""
    made = pieces(docs, tokenizer, capacity, end_id, **{"batch_chars": 500_000, "spare": True} | names).withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut(made, "pieces"), capacity)


def op9_packing(spark, sf_dir):
    """The digest of each piece's ids comes from the ids themselves; only the digest is written.
    No other stage needs the workers' memory, so they remember more words than by default."""
    made = pieces(table(spark, sf_dir, "documents"), cached_words=500_000).withColumn("ids_crc32", F.crc32("ids"))
    return pack(cut(made.drop("ids"), "pieces"))
