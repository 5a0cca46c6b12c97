"""Operator 2, language ID by Bayesian evidence fusion.

Each row's evidence for a language is added up in logarithms:
- the text: byte trigrams of letters and spaces over the whole text under each language's smoothed counts, tempered to
  what `weight` independent trigrams would say; a uniform background model stands for `und`;
- the declared language (of `lang=` in the row's markup, or of a column), right in `declared_trust`;
- the address suffix (of the url's host), right in `suffix_trust`;
- the host's prior. Soft counts of the other evidence are summed by host, hosts by parent domain,
  and all together (grouped aggregations); each level is smoothed by the one above it with
  `strength` pseudo rows.
A row is accepted if the likeliest language is not `und` and has a probability of `least` or more.

The text model is fitted on at most `SAMPLE` texts of every label, those with the smallest hash
of the id; a text over `SAMPLE_BYTES` bytes gives a window of that size; labels are no evidence.

Defined results: a null or empty text, or one without a letter, is `und`; a null host shares
the global prior; rows with a null id are judged too; rows that repeat an id are judged each; an
empty table, or one without labels, gives `und` only; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, join_groups, materialize, slices, small, utf8

SAMPLE, SAMPLE_BYTES = 400, 8192
#: Slots that trigrams are hashed to; bytes of text worked on at a time.
SLOTS, BLOCK = 1 << 15, 1 << 18
UND = "und"
#: Fixed: top-level domains of languages.
SUFFIXES = {"de": "de", "at": "de", "fr": "fr", "es": "es", "mx": "es", "uk": "en", "us": "en", "au": "en", "ie": "en"}
_MARKUP = r"(?i)<html[^>]*\s(?:xml:)?lang\s*=\s*[\"']?([a-z]{2,3})"
_HOST = r"(?s)^.*?://([^/?#]*)"
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORDY = _LETTER.copy()
_WORDY[32] = True
#: Log prior of `und` against a language.
UND_PRIOR = float(np.log(1e-4))


def trigram_slots(data: np.ndarray) -> np.ndarray:
    """A slot for each place of the bytes but the last two."""
    x = _LOWER[data]
    return ((x[:-2] * np.uint32(65599 * 65599 & 0xFFFFFFFF) + x[1:-1] * np.uint32(65599) + x[2:]) * np.uint32(2654435761)) >> np.uint32(17)


def has_letters(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    out = np.zeros(len(off) - 1, bool)
    for first, last in slices(off, BLOCK):
        bounds = off[first : last + 1] - off[first]
        so_far = np.concatenate([[0], np.cumsum(_LETTER[data[off[first] : off[last]]], dtype=np.int32)])
        out[first:last] = so_far[bounds[1:]] > so_far[bounds[:-1]]
    return out


@dataclass(frozen=True)
class TextModel:
    languages: tuple[str, ...]
    table: np.ndarray  # SLOTS x (languages + und), log probabilities

    def evidence(self, data: np.ndarray, off: np.ndarray, weight: float) -> np.ndarray:
        """Log evidence of each text for each language and `und`. Blocks of bytes are worked on, wherever texts begin and end, so a long text takes no more room."""
        sums = np.zeros((len(off) - 1, self.table.shape[1] + 1))
        for at in range(int(off[0]), int(off[-1]), BLOCK):
            stop = min(at + BLOCK, int(off[-1]))
            part = data[at : min(stop + 2, int(off[-1]))]
            if len(part) < 3:
                continue
            wordy = _WORDY[part]
            wordy = wordy[:-2] & wordy[1:-1] & wordy[2:]
            # a last row for runs that end with the block
            scores = np.zeros((len(wordy) + 1, self.table.shape[1] + 1), np.float32)
            places = np.flatnonzero(wordy)
            scores[places, :-1] = self.table[trigram_slots(part)[places]]
            scores[places, -1] = 1
            first, last = int(np.searchsorted(off, at, "right")) - 1, int(np.searchsorted(off, stop, "left"))
            low = np.maximum(off[first:last] - at, 0)
            high = np.clip(off[first + 1 : last + 1] - 2 - at, 0, len(wordy))
            some = np.flatnonzero(high > low)
            # sums between each text's first trigram here and the end of its last
            cuts = np.stack([low[some], high[some]], 1).ravel()
            if len(cuts):
                sums[first + some] += np.add.reduceat(scores, cuts, axis=0, dtype=np.float64)[::2]
        n = sums[:, -1:]
        return sums[:, :-1] / np.maximum(n, 1) * np.minimum(n, weight)


def fit_text_model(df: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> TextModel:
    """Counts trigrams of a bounded sample of texts of every label on the driver; of a longer text a window of most_bytes, placed by the id's hash, counts.

    Which rows are taken is decided on (label, hash) alone: a threshold by label, from the number of its distinct
    hashes, leaves a few times the sample; only the chosen rows' windows reach the driver.
    """
    data = F.col(text_col).cast("string").cast("binary")
    h = F.when(F.col(id_col).isNull(), F.xxhash64(data)).otherwise(F.xxhash64(id_col))
    start = F.pmod(h, F.greatest(F.octet_length(data) - most_bytes + 1, F.lit(1)).cast("long")).cast("int") + 1
    labelled = df.where(F.col(label_col).isNotNull() & (F.octet_length(data) >= 3)).select(F.col(label_col).alias("label"), h.alias("h"), F.substring(data, start, F.lit(most_bytes)).alias("window"))
    size = labelled.groupBy("label").agg(F.approx_count_distinct("h").alias("n"))
    size = df.sparkSession.createDataFrame(size.collect(), size.schema)  # a row a label, as the model has
    place = F.shiftrightunsigned("h", 12) / float(1 << 52)  # in [0, 1), uniform
    some = labelled.select("label", "h").join(F.broadcast(size), "label").where(place * F.col("n") <= 3.0 * sample + 60).groupBy("label", "h").agg(place.alias("at"))
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("label").orderBy("at", "h"))).where(F.col("rank") <= sample).select(F.col("label").alias("l"), F.col("h").alias("k"))
    chosen = labelled.join(F.broadcast(ranked), (F.col("label") == F.col("l")) & (F.col("h") == F.col("k")))  # ranked: `sample` rows a label
    counts: dict[str, np.ndarray] = {}
    for r in chosen.groupBy("label", "h").agg(F.min("window").alias("window")).collect():
        own = counts.setdefault(r["label"], np.zeros(SLOTS))
        own += np.bincount(trigram_slots(np.frombuffer(r["window"], np.uint8)), minlength=SLOTS)
    table = np.full((SLOTS, len(counts) + 1), -np.log(SLOTS), np.float32)
    for k, name in enumerate(sorted(counts)):
        table[:, k] = np.log((counts[name] + 0.05) / (counts[name].sum() + 0.05 * SLOTS))
    return TextModel(tuple(sorted(counts)), table)


def _known(value: Column, languages: tuple[str, ...], trust: float) -> list[Column]:
    """Log likelihood, for each language and und, that a source says `value`; none if it says nothing known."""
    other = (1 - trust) / max(1, len(languages) - 1)
    return [F.when(value == x, F.lit(float(np.log(trust)))).when(value.isin(*languages), F.lit(float(np.log(other)))).otherwise(F.lit(0.0)) for x in languages] + [F.when(value.isin(*languages), F.lit(float(np.log(1 / len(languages))))).otherwise(F.lit(0.0))]


def _softmax(x: str) -> Column:
    top = F.array_max(x)
    powers = F.transform(x, lambda v: F.exp(v - top))
    return F.transform(powers, lambda v: v / F.aggregate(powers, F.lit(0.0), lambda a, b: a + b))


def _sums(column: str, n: int) -> list[Column]:
    return [F.sum(F.col(column)[k]).alias(f"s{k}") for k in range(n)]


def host_priors(rows: DataFrame, n: int, strength: float) -> DataFrame:
    """h (the host), prior, n (its rows): soft counts by host, smoothed by its parent domain's, those by all rows'.

    rows: host, share (array of n). The parent of a host is what follows its first dot.
    """
    hosts = materialize(rows.groupBy("host").agg(*_sums("share", n), F.count("*").alias("n")).withColumn("parent", F.when(F.col("host").contains("."), F.expr("substring(host, locate('.', host) + 1)"))), "hosts")
    total = hosts.agg(*[F.sum(f"s{k}").alias(f"g{k}") for k in range(n)], F.sum("n").alias("all"))
    parents = hosts.where("parent is not null").groupBy("parent").agg(*[F.sum(f"s{k}").alias(f"p{k}") for k in range(n)], F.sum("n").alias("pn"))
    known = hosts.join(parents, "parent", "left").join(F.broadcast(total))  # total: one row
    smooth = lambda own, size, above: (F.coalesce(own, F.lit(0.0)) + strength * above) / (F.coalesce(size, F.lit(0)) + strength)
    world = [(F.col(f"g{k}") + 1.0 / n) / (F.col("all") + 1.0) for k in range(n)]
    above = [smooth(F.col(f"p{k}"), F.col("pn"), world[k]) for k in range(n)]
    return known.select(F.col("host").alias("h"), F.array(*[smooth(F.col(f"s{k}"), F.col("n"), above[k]) for k in range(n)]).alias("prior"), "n")


def identify(df: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", host_col: str | None = None, url_col: str | None = None, declared_col: str | None = None, weight: float = 60.0, declared_trust: float = 0.9, suffix_trust: float = 0.8, strength: float = 20.0, least: float = 0.5) -> DataFrame:
    """id, language, confidence, accepted, host, declared, suffix (null where unknown) of each row.

    declared_col: else the declaration is looked up in the text's own markup. host_col: else the url's host.
    """
    languages, size = model.languages, len(model.languages) + 1
    text = F.col(text_col).cast("string")
    host = F.lower(F.regexp_extract(F.col(url_col), _HOST, 1)) if url_col else F.lit(None).cast("string")
    suffix_map = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    wanted = df.select(
        F.col(id_col).alias("id"),
        text.alias("text"),
        (F.col(host_col).cast("string") if host_col else host).alias("host"),
        (F.lower(F.col(declared_col)) if declared_col else F.nullif(F.lower(F.regexp_extract(text, _MARKUP, 1)), F.lit(""))).alias("declared"),
        F.try_element_at(suffix_map, F.element_at(F.split(host, r"\."), -1)).alias("suffix"),
    )
    id_type = dict(wanted.dtypes)["id"]
    keep = ["id", "host", "declared", "suffix"]

    def run(batches):
        for b in small(batches):
            data, off = utf8(b.column(1))
            said = model.evidence(data, off, weight)
            said[:, -1] += np.where(has_letters(data, off), UND_PRIOR, 50.0)  # no letter, no language
            fields = {x: b.column(b.schema.get_field_index(x)) for x in keep}
            fields["said"] = pa.FixedSizeListArray.from_arrays(pa.array(said.ravel()), size).cast(pa.list_(pa.float64()))
            yield batch(fields, pa.schema([(x, v.type) for x, v in fields.items()]))

    rows = wanted.mapInArrow(run, f"id {id_type}, host string, declared string, suffix string, said array<double>")
    declared, suffix = (_known(F.col(x), languages, t) if languages else [F.lit(0.0)] for x, t in (("declared", declared_trust), ("suffix", suffix_trust)))
    rows = rows.withColumn("evidence", F.array(*[F.col("said")[k] + declared[k] + suffix[k] for k in range(size)]))
    rows = materialize(rows.withColumn("share", _softmax("evidence")).drop("said"), "evidence")
    priors = host_priors(rows.where("host is not null and host != ''"), size, strength).withColumnRenamed("h", "host")
    fused = join_groups(rows, priors, ["host"], "n", rows.count()).withColumn("post", F.when(F.col("prior").isNull(), F.col("evidence")).otherwise(F.zip_with("evidence", "prior", lambda e, p: e + F.log(p))))
    best = F.array_max("p")
    names = F.array(*[F.lit(x) for x in (*languages, UND)])
    out = fused.withColumn("p", _softmax("post")).withColumn("confidence", best).withColumn("language", F.element_at(names, F.array_position("p", best).cast("int")))
    return out.select(F.col("id").alias(id_col), "language", "confidence", ((F.col("language") != UND) & (F.col("confidence") >= least)).alias("accepted"), "host", "declared", "suffix")
