"""Operator 1, best-fit packing: best-two-fit over the histogram of piece lengths.

`encode_pieces` tokenizes whole texts and cuts only those longer than the budget.
`best_two_fit` packs lengths: it fills a bin greedily with the longest that fits, then
replaces the bin's smallest document by two unpacked ones that fill the widened gap more
tightly. Documents of one length are interchangeable, so the plan is made on counts per
length: at most `budget` rows reach the driver, however large the corpus is, and a plan row
says which ranks of a length go to which sequences. Each piece gets its rank without a sort:
its rank among the equally long pieces of its task, plus the counts of the tasks before.

Defined results: a null text is an empty one (one piece holding only the separator); rows
with a null or repeated id are packed like any other row, each on its own; an empty table
gives no sequences; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, materialize, small

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local_rank long"
#: Words kept per task; the table starts anew when full.
CACHE_WORDS = 1_200_000
#: Punctuation that is cut off behind a word: a run of it is a word of its own.
_BEHIND = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Texts whose words are looked up together.
TEXTS = 1024
#: Arrow's split treats these as space, the tokenizer doesn't; and its special tokens all start so.
_ODD = "[\\x1c-\\x1f]|<\\|"


class WordEncoder:
    """Ids of texts by a tokenizer whose words never span white space, as little-endian uint32 bytes.

    Arrow splits the texts and numbers their distinct runs of non-space characters; each is encoded once by the
    tokenizers library, and a text's ids are gathered by these numbers. Runs of letters, in lower case
    and without punctuation behind, go to the library as one long text: the last token of a word is known by its mark
    in the vocabulary.
    """

    def __init__(self, path: str, most: int = CACHE_WORDS):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words, self.most = Tokenizer.from_file(path), {}, most
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            suffix = json.load(f)["model"]["end_of_word_suffix"]
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for s, i in vocab.items() if s.endswith(suffix)]] = True

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, runs: set[str]) -> None:
        """Makes the ids of all runs known."""
        known = self.words
        missing = runs.difference(known)
        if len(known) + 2 * len(missing) > self.most:
            known.clear()
            missing = runs
        plain, rest, split = set(), set(), []
        for run in missing:
            word = run.rstrip(_BEHIND)
            # letters of Latin-1 have one form, and one lower-case letter each
            if word.isalpha() and (word.isascii() or max(word) <= "\u00ff"):
                low = word.lower()
                if low != run:
                    tail = run[len(word) :]
                    split.append((run, low, tail))
                    if tail:
                        rest.add(tail)
                plain.add(low)
            else:
                rest.add(run)
        new = list(plain.difference(known))
        if new:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids, "<u4")
            flat, ends = ids.tobytes(), ((np.flatnonzero(self.last[ids]) + 1) * 4).tolist()
            known.update(zip(new, [flat[x:y] for x, y in pairwise([0, *ends])], strict=True))
        odd = list(rest.difference(known))
        for k in range(0, len(odd), 4096):
            known.update(zip(odd[k : k + 4096], self._encode(odd[k : k + 4096]), strict=True))
        for run, low, tail in split:
            known[run] = known[low] + known[tail] if tail else known[low]

    def __call__(self, texts: pa.Array) -> Iterator[bytes]:
        for k in range(0, len(texts), TEXTS):
            yield from self._some(pc.fill_null(texts.slice(k, TEXTS).cast(pa.large_string()), ""))

    def _some(self, texts: pa.Array) -> Iterator[bytes]:
        odd = pc.match_substring_regex(texts, _ODD)
        lists = pc.utf8_split_whitespace(pc.if_else(odd, "", texts))
        coded = lists.flatten().dictionary_encode()
        runs, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self._learn(set(runs) - {""})
        self.words[""] = b""  # what stands before and behind the outer spaces
        parts = list(map(self.words.__getitem__, runs))
        ids = np.frombuffer(b"".join(parts), "<u4")
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        starts = np.cumsum(sizes) - sizes
        n = sizes[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        place = np.repeat((starts[at] - ends + n).astype(np.int32), n)
        place += np.arange(total, dtype=np.int32)
        flat = ids.take(place)
        bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        for k, strange in enumerate(odd.to_pylist()):
            yield self._encode([texts[k].as_py()])[0] if strange else flat[bounds[k] : bounds[k + 1]].tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The process's encoder of a tokenizer file, with an empty table."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    _ENCODERS[path].words = {}
    return _ENCODERS[path]


def encode_pieces(df: DataFrame, tokenizer: str, budget: int = 4096, separator: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row per piece: id, piece, start, length, ids_crc32, the task and the rank of its length there; with_ids adds the ids (binary, uint32)."""
    out = PIECES + (", ids binary" if with_ids else "")

    def run(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(budget + 1, np.int64)
        encode, end = encoder_of(tokenizer), np.array([separator], "<u4").tobytes()
        for b in small(batches):
            rows: list[tuple] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode(b.column(1)), strict=True):
                ids += end
                for k, at in enumerate(range(0, len(ids), 4 * budget)):
                    own = ids[at : at + 4 * budget]
                    n = len(own) // 4
                    rows.append((doc, k, at // 4, n, zlib.crc32(own), task, int(seen[n]), own if with_ids else None))
                    seen[n] += 1
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local_rank", "ids"]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            schema = pa.schema(list(zip(names, kinds, strict=True))[: 8 if with_ids else 7])
            yield batch(dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in names}, schema)
        encode.words = {}

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, out)


def best_two_fit(counts: np.ndarray, capacity: int) -> tuple[list[tuple], int]:
    """Packs counts[l] documents of each length l into bins of the capacity.

    Returns plan rows (length, first rank, ranks, copies a bin, first bin, offset in the bin)
    and the number of bins. Bins alike are planned at once, as often as the counts allow, so
    the number of steps follows the distinct lengths and not the documents.
    """
    left, plan, bins = counts.astype(np.int64).copy(), [], 0
    used = np.zeros_like(left)
    while True:
        lengths = np.flatnonzero(left)  # ascending; 0 never occurs
        if not len(lengths):
            return plan, bins
        inside: dict[int, int] = {}
        gap, upto = capacity, len(lengths)
        while upto and gap:
            upto = int(np.searchsorted(lengths[:upto], gap, "right"))
            if not upto:
                break
            x = int(lengths[upto - 1])
            n = min(int(left[x]), gap // x)
            inside[x] = n
            gap -= n * x
            upto -= 1
        if gap and sum(inside.values()) > 1:
            small = min(inside)
            pair = _two(left, lengths, inside, gap + small, small)
            if pair:
                inside[small] -= 1
                for x in pair:
                    inside[x] = inside.get(x, 0) + 1
        inside = {x: n for x, n in inside.items() if n}
        times = min(int(left[x]) // n for x, n in inside.items())
        at = 0
        for x in sorted(inside, reverse=True):
            n = inside[x]
            plan.append((x, int(used[x]), times * n, n, bins, at))
            at += n * x
            used[x] += times * n
            left[x] -= times * n
        bins += times


def _two(left: np.ndarray, lengths: np.ndarray, inside: dict[int, int], room: int, more_than: int) -> tuple[int, int] | None:
    """The two lengths, still unpacked, with the largest sum over more_than and up to room."""
    rest = lengths[: np.searchsorted(lengths, room)]
    unpacked = left[rest]
    for x, n in inside.items():
        if x < room:
            unpacked[np.searchsorted(rest, x)] -= n
    rest, unpacked = rest[unpacked > 0], unpacked[unpacked > 0]
    if not len(rest):
        return None
    at = np.searchsorted(rest, room - rest, "right") - 1  # the largest partner that fits
    at -= (at == np.arange(len(rest))) & (unpacked < 2)
    total = np.where(at >= 0, rest + rest[at], 0)
    k = int(total.argmax())
    return (int(rest[k]), int(rest[at[k]])) if total[k] > more_than else None


def pack(pieces: DataFrame, budget: int = 4096) -> DataFrame:
    """pieces (of encode_pieces) with sequence_id and offset; gapless from 0 in every sequence."""
    pieces = materialize(pieces, "pieces")
    by_task = pieces.groupBy("part", "length").agg((F.max("local_rank") + 1).alias("n"))
    counts = np.zeros(budget + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # a row per length: budget rows at most
        counts[r["length"]] = r["count"]
    plan, _ = best_two_fit(counts, budget)
    rows = np.array(sorted(plan), np.int64).reshape(-1, 6)  # bounded: lengths x bins that differ
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = by_task.select(F.col("part").alias("p"), F.col("length").alias("l"), (F.sum("n").over(before) - F.col("n")).alias("before"))
    ranked = pieces.join(first, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l"))).withColumn("rank", F.col("before") + F.col("local_rank")).drop("p", "l", "before", "part", "local_rank")

    def run(batches):
        keys = (rows[:, 0] << 44) + rows[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(x)).to_numpy(zero_copy_only=False) for x in ("length", "rank"))
            x = rows[np.searchsorted(keys, (length << 44) + rank, "right") - 1]
            place = rank - x[:, 1]
            out = {n: b.column(k) for k, n in enumerate(b.schema.names) if n != "rank"}
            out |= {"sequence_id": x[:, 4] + place // x[:, 3], "offset": x[:, 5] + place % x[:, 3] * x[:, 0]}
            yield pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, pa.int64()) for v in out.values()], names=list(out))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id long, offset long"
    return ranked.mapInArrow(run, schema)
