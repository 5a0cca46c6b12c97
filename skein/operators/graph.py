"""The temporal entity graph: extraction, co-occurrence, domains, timelines, related notes."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import vocab
from skein.functions import text
from skein.operators import extraction
from skein.sources.writers import scratch, written


def entities(docs: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str], aliases: Mapping[str, str] = {}, stop: tuple[str, ...] = ()) -> DataFrame:
    """KG1-2: id, type, name, entity_id, place: lower-cased names by typed patterns (group 1), each once a text.

    place orders a text's entities by pattern, then by first occurrence in it.
    """
    listed = [F.struct(F.lit(k).alias("k"), F.lit(kind).alias("type"), F.transform(F.regexp_extract_all(F.col(text_col), F.lit(p), 1), lambda x: F.lower(x)).alias("names")) for k, (kind, p) in enumerate(patterns.items())]
    each = docs.select(F.col(id_col).alias("id"), F.explode(F.array(*listed)).alias("f")).select("id", "f.k", "f.type", F.posexplode("f.names").alias("at", "name"))
    if aliases:
        table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
        each = each.withColumn("name", F.coalesce(F.try_element_at(table, F.col("name")), F.col("name")))
    each = each.where((F.col("name") != "") & ~F.col("name").isin(*stop)) if stop else each.where("name != ''")
    once = each.groupBy("id", "k", "type", "name").agg(F.min("at").alias("at"))
    return once.select("id", "type", "name", F.concat_ws(":", "type", "name").alias("entity_id"), (F.row_number().over(Window.partitionBy("id").orderBy("k", "at", "name"))).cast("long").alias("place"))


#: Rows a part of what is paired.
ROWS = 2**18


def cooccurrence(links: DataFrame, group: str, member: str, most: int = 8) -> DataFrame:
    """KG6-7, JN14: subject < object, weight = groups that hold both; of a group its first `most` members pair up (a bound of the operator)."""
    n = max(1, -(-links.count() // ROWS))  # parts grow with the rows, so none outgrows its task
    dealt = links.where(F.col(group).isNotNull()).select(group, member).repartition(n, group).distinct()
    first = dealt.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(member))).where(F.col("_n") <= most)
    # `most` members at most
    listed = first.groupBy(group).agg(F.collect_list(member).alias("m"))
    couples = F.flatten(F.transform("m", lambda a: F.transform(F.filter("m", lambda b: a < b), lambda b: F.struct(a.alias("subject"), b.alias("object")))))
    return listed.select(F.inline(couples)).repartition(n, "subject", "object").groupBy("subject", "object").agg(F.count("*").alias("weight"))


def mentions(docs: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str], aliases: Mapping[str, str] = {}, stop: tuple[str, ...] = ()) -> DataFrame:
    """KG1: as `entities`, with the offset of each entity's first mention: id, type, name, entity_id, place, first_at.

    A name is the first group that isn't empty, else the whole match. Offsets come from cutting the text at the matches of
    a pattern: what stands before the n-th match is the pieces and the matches before it.
    """

    def matches(p: str) -> Column:
        """gap (characters before a match since the last one), size and name of all matches of a pattern."""
        n = re.compile(p).groups
        groups = [F.regexp_extract_all(F.col(text_col), F.lit(p), g).alias(f"g{g}") for g in range(n + 1)]
        gaps = F.transform(F.split(F.col(text_col), p, -1), lambda x: F.length(x)).alias("gap")
        name = lambda x: F.coalesce(*[F.nullif(x[f"g{g}"], F.lit("")) for g in range(1, n + 1)], F.lit("")) if n else x["g0"]
        found = F.filter(F.arrays_zip(*groups, gaps), lambda x: x["g0"].isNotNull())
        return F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), F.length(x["g0"]).alias("size"), F.lower(F.trim(name(x))).alias("name")))

    def located(k: int, kind: str, p: str) -> Column:
        def placed(found: Column) -> Column:
            ends = extraction.running(F.transform(found, lambda x: x["gap"] + x["size"]), lambda a, b: a + b)
            return text.let(ends, lambda e: F.transform(found, lambda x, n: F.struct(F.lit(k).alias("k"), named(x["name"]).alias("name"), (F.get(e, n) - x["size"]).cast("long").alias("first_at"), F.lit(kind).alias("type"))))

        return F.filter(text.let(matches(p), placed), lambda x: x["name"].isNotNull())

    def named(name: Column) -> Column:
        """The name that it means; null for one that is none."""
        full = F.coalesce(F.try_element_at(table, name), name) if aliases else name
        return F.when((name != "") & ~name.isin(*stop) if stop else name != "", full)

    table = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv]) if aliases else None
    # all is within a row: sorted by name, the first mention of each is the one that differs from its neighbour
    listed = F.array_sort(F.concat(*[located(k, kind, p) for k, (kind, p) in enumerate(patterns.items())]))
    firsts = text.let(listed, lambda xs: F.filter(xs, lambda x, n: (n == 0) | (x["k"] != F.get(xs, n - 1)["k"]) | (x["name"] != F.get(xs, n - 1)["name"])))
    ordered = F.array_sort(F.transform(firsts, lambda x: F.struct(x["k"].alias("k"), x["first_at"].alias("first_at"), x["name"].alias("name"), x["type"].alias("type"))))
    each = docs.select(F.col(id_col).alias("id"), F.posexplode(ordered).alias("n", "x"))
    return each.select("id", "x.type", "x.name", F.concat_ws(":", "x.type", "x.name").alias("entity_id"), (F.col("n") + 1).cast("long").alias("place"), "x.first_at")


def service_automaton(services: tuple[str, ...]):
    """One automaton over all names."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, name in enumerate(services):
        found.add_word(name, (k, name))
    found.make_automaton()
    return found


#: What a pattern that ignores case takes for an ASCII letter: letter for letter, so that offsets stay.
_FOLDED = {k: chr(k + 32) for k in range(65, 91)} | {0x17F: "s", 0x212A: "k"}


def services_in(body: str, automaton, guards: Mapping[str, tuple[str, ...]] = vocab.SERVICE_GUARDS) -> list[tuple[int, str]]:
    """Offset and name, as it is written, of the services in a text, from left to right without overlaps, in one pass over it.

    A name stands between ends of words; of several that begin together the first listed counts. A guarded name is none where
    one of its words follows: a compound product is named by its second word.
    """
    folded = body.translate(_FOLDED)
    word = lambda k: 0 <= k < len(body) and (body[k].isalnum() or body[k] == "_")
    candidates = []
    for end, (rank, name) in automaton.iter(folded):
        start = end - len(name) + 1
        if word(start - 1) or word(end + 1):
            continue
        if name in guards:
            rest = re.match(r"\s+", body[end + 1 :])
            if rest and folded.startswith(guards[name], end + 1 + rest.end()):
                continue
        candidates.append((start, rank, name))
    out, free = [], 0
    for start, _, name in sorted(candidates):
        if start >= free:
            free = start + len(name)
            out.append((start, body[start:free]))
    return out


def built_in_mentions(docs: DataFrame, id_col: str, text_col: str, services: tuple[str, ...] = vocab.SERVICES, forms: Mapping[str, str] = vocab.ENTITY_FORMS, kinds: tuple[str, ...] = vocab.ENTITY_KINDS, aliases: Mapping[str, str] = vocab.ENTITY_ALIASES, stop: tuple[str, ...] = vocab.ENTITY_STOP) -> DataFrame:
    """KG1-2, KG14: as `mentions`, with the built-in kinds: services by an automaton, the other kinds by their forms; in any case.

    A text is read in an Arrow task and goes through no exchange. Texts that are null have no entities. The case of letters is folded as
    a pattern that ignores case does it.
    """
    schema = pa.schema([("id", pa.int64()), ("type", pa.string()), ("name", pa.string()), ("entity_id", pa.string()), ("place", pa.int64()), ("first_at", pa.int64())])

    def run(batches):
        automaton = service_automaton(services)
        compiled = {kind: re.compile(p, re.I) for kind, p in forms.items()}
        for b in batches:
            out = []
            for key, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen = {}
                for kind in kinds:
                    if kind == "service":
                        found = services_in(body or "", automaton)
                    elif kind in compiled:
                        found = [(m.start(), next((g for g in m.groups() if g), "") if m.re.groups else m[0]) for m in compiled[kind].finditer(body or "")]
                    else:
                        continue
                    for at, name in found:
                        name = name.lower().strip()
                        if name and name not in stop:
                            seen.setdefault((kind, aliases.get(name, name)), at)
                out += [(key, kind, name, f"{kind}:{name}", n, at) for n, ((kind, name), at) in enumerate(seen.items(), 1)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, type string, name string, entity_id string, place long, first_at long")


def pair_up(found: DataFrame, most: int = vocab.PAIR_MOST, window: int = vocab.PAIR_WINDOW, unpaired: tuple[str, ...] = vocab.UNPAIRED_TYPES) -> tuple[DataFrame, DataFrame]:
    """KG6-7, JN14: edges (subject < object, predicate, weight = facts that give it, first = the smallest such id), and slots dropped by the bound: id, dropped.

    found: of `mentions`. Of each fact the first `most` entities by pattern and offset pair up (the rule of the graph, at most 28 pairs a fact),
    if their first mentions are at most `window` characters apart.
    """
    open_rows = found.where(~F.col("type").isin(*unpaired))
    ranked = open_rows.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("place")))
    dropped = ranked.where(F.col("_n") > most).groupBy("id").agg(F.count("*").alias("dropped"))
    first = ranked.where(F.col("_n") <= most).groupBy("id").agg(F.collect_list(F.struct("entity_id", "type", "first_at")).alias("e"))  # `most` a fact
    pairs = F.flatten(F.transform("e", lambda a: F.transform(F.filter("e", lambda b: (a["entity_id"] < b["entity_id"]) & (F.abs(a["first_at"] - b["first_at"]) <= window)), lambda b: F.struct(a["entity_id"].alias("subject"), F.when(a["type"] == b["type"], "co_occurs_with").otherwise("mentioned_with").alias("predicate"), b["entity_id"].alias("object")))))
    each = first.select("id", F.explode(pairs).alias("p")).select("id", "p.*")
    return each.groupBy("subject", "predicate", "object").agg(F.count("*").alias("weight"), F.min("id").alias("first")), dropped


def first_domains(found: DataFrame, facts: DataFrame) -> DataFrame:
    """KG4: each entity with its type, name and the domain of the first fact (by id) that has it. facts: id, domain."""
    rows = found.join(facts.select("id", "domain"), "id")
    return rows.groupBy("entity_id").agg(F.min("type").alias("type"), F.min("name").alias("name"), F.min_by("domain", "id").alias("domain"), F.count("*").alias("facts"))


def load_patterns(builtin: Mapping[str, str], custom: Mapping[str, str], preset: str = "default") -> tuple[dict[str, str], list[str]]:
    """KG14: built-in patterns unless the preset is `none`, with a configuration's over them, and the names of those that aren't valid."""
    merged = ({} if preset == "none" else dict(builtin)) | dict(custom)
    good, bad = {}, []
    for name, p in merged.items():
        try:
            re.compile(p)
            good[name] = p
        except re.error:
            bad.append(name)
    return good, bad


def majority(rows: DataFrame, key: str, value: str, weak: str | None = None) -> DataFrame:
    """KG9, JN4, WIN4: each key's most frequent value, ties by value; `weak` only where there is no other."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    rank = (F.col(value) == weak).cast("int") if weak else F.lit(0)
    best = F.min(F.struct(rank.alias("w"), (-F.col("n")).alias("n"), F.col(value).alias("v")))
    return counts.groupBy(key).agg(best.alias("b")).select(key, F.col("b.v").alias(value), (-F.col("b.n")).alias("votes"))


def add_triples(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """KG5: null-safe deduplication on subject, predicate, object, valid_from; old rows stay."""
    return old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)), allowMissingColumns=True).withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy("_o"))).where("_n = 1").drop("_n", "_o")


def timeline(triples: DataFrame) -> DataFrame:
    """KG11, SET1, SRT6: every edge seen from both ends, open ones last."""
    out = triples.select(F.col("subject").alias("entity"), F.lit("out").alias("dir"), "predicate", F.col("object").alias("other"), "valid_from", "valid_to")
    back = triples.select(F.col("object").alias("entity"), F.lit("in").alias("dir"), "predicate", F.col("subject").alias("other"), "valid_from", "valid_to")
    return out.unionByName(back)


#: Entities of a document up to which it is found by pairs of entities; rows of one key that a list or a part of a join holds.
WIDE, PART = 512, 512


def _joined(left: DataFrame, right: DataFrame, key: str, by: str, least: int = 1) -> tuple[DataFrame, int]:
    """Both sides joined by a key, in parts whose number grows with the pairs, and that number.

    The right side's rows of a frequent key are dealt by `by` into parts of about PART, the left side's are repeated for each. Keys of fewer than `least` pairs are left out.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("_l")).join(right.groupBy(key).agg(F.count("*").alias("_r")), key).where(F.col("_l") * F.col("_r") >= least)
    spread = counts.select(key, (F.col("_l").cast("double") * F.col("_r")).alias("_pairs"), F.ceil(F.col("_r") / PART).cast("long").alias("_parts"))
    n = int(min(4096, (spread.agg(F.sum("_pairs")).first()[0] or 0) // ROWS + 1))
    a = left.join(spread, key).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1))).drop("_pairs", "_parts")
    b = right.join(spread, key).withColumn("_part", F.pmod(F.xxhash64(by), F.col("_parts"))).drop("_pairs", "_parts")
    return a.repartition(n, key, "_part").join(b.repartition(n, key, "_part"), [key, "_part"]).drop("_part"), n


def _by_pairs(classes: DataFrame, path: str) -> DataFrame:
    """a, b, size (of b), shared, weight, strong of classes that share two entities; all rows of an a are in one task.

    A class goes once to each pair of its entities, where the classes that meet are listed, PART in a list. What moves from there is
    a class with a list, not a row a pair of classes; of a key with several lists each meets each.
    """
    couples = F.flatten(F.transform("es", lambda a: F.transform(F.filter("es", lambda b: a["i"] < b["i"]), lambda b: F.struct(a["i"].alias("i"), b["i"].alias("j"), (a["idf"] + b["idf"]).alias("idf"), (a["strong"] + b["strong"]).alias("strong")))))
    listed = F.size("es").cast("long")
    total = classes.agg(F.sum(listed * (listed - 1) / 2)).first()[0] or 0
    keyed = classes.select("c", "size", F.inline(couples)).repartition(int(total // ROWS + 1), "i", "j")
    key = Window.partitionBy("i", "j")
    met = keyed.withColumn("_n", F.row_number().over(key.orderBy("c"))).withColumn("_m", F.count("*").over(key)).where("_m > 1")
    chunked = met.groupBy("i", "j", F.floor((F.col("_n") - 1) / PART).alias("chunk")).agg(F.first("_m").alias("m"), F.first("idf").alias("idf"), F.first("strong").alias("strong"), F.collect_list(F.struct("c", "size")).alias("l"))  # PART at most
    lists = written(chunked.select("i", "j", "chunk", "m", "idf", "strong", F.col("l.c").alias("cs"), F.col("l.size").alias("sizes")), f"{path}/lists")

    def but(c: str, at: Column) -> Column:
        return F.filter(c, lambda x, k: k != at).alias(c)

    short = lists.where(F.col("m") <= PART).select("idf", "strong", F.inline(F.transform("cs", lambda c, at: F.struct(c.alias("a"), but("cs", at), but("sizes", at)))))
    long = lists.where(F.col("m") > PART)
    facing = long.select("i", "j", F.col("cs").alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / PART))).alias("chunk"))
    crossed = facing.join(long, ["i", "j", "chunk"]).select("idf", "strong", F.explode("own").alias("a"), "cs", "sizes")
    parts = int(min(4096, (lists.agg(F.sum(F.size("cs") * F.col("m"))).first()[0] or 0) // ROWS + 1))
    each = short.unionByName(crossed).repartition(parts, "a").select("a", "idf", "strong", F.inline(F.arrays_zip("cs", "sizes"))).withColumnsRenamed({"cs": "b", "sizes": "size"})
    # of s shared entities each is in s - 1 of the s(s - 1)/2 pairs
    shared = F.round((F.sqrt(F.lit(1) + 8 * F.count("*")) + 1) / 2)
    return each.where("a != b").groupBy("a", "b").agg(F.first("size").alias("size"), shared.cast("long").alias("shared"), (F.sum("idf") / (shared - 1)).alias("weight"), F.sum("strong").alias("strong"))


def related(links: DataFrame, doc: str, entity: str, max_share: float = 0.2, least_shared: int = 2, most: int = 4, weak: str | None = None) -> DataFrame:
    """KG13, JN13: for each document the `most` others that share `least_shared` (2 at least) rare entities, by summed idf over log2(2 + their size).

    Entities in one document, or in more than max_share of them (2 at least), say nothing. weak: a boolean column; entities
    that are can support a link, but one that isn't must be shared too.
    Documents with the same rare entities and size score alike, so classes of them are compared: of a class at most its `most` + 1 smallest documents
    can be in a list, and all its documents have the same list but for themselves. So copies of documents add no pairs.
    Two classes that share two entities meet by a pair of entities, so what shares only one - most of what shares anything - is
    never listed. A class with more than WIDE rare entities would have too many pairs: it meets others by single ones.
    """
    if least_shared < 2:
        raise ValueError("least_shared: 2 at least")
    path = scratch(links.sparkSession, "related")

    def kept(rows: DataFrame, name: str) -> DataFrame:
        return written(rows, f"{path}/{name}")

    strength = (~F.col(weak)).cast("int") if weak else F.lit(1)
    once = kept(links.select(F.col(doc).alias("d"), F.col(entity).alias("e"), strength.alias("strong")).groupBy("d", "e").agg(F.max("strong").alias("strong")), "once")
    size = once.where("d is not null").groupBy("d").agg(F.count("*").alias("size"))
    n = size.agg(F.count("*").alias("n"))  # one row
    df = once.groupBy("e").agg(F.count("*").alias("df"))
    rare = df.join(F.broadcast(n)).where((F.col("df") > 1) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n") * max_share)))).select("e", F.log(F.col("n") / F.col("df")).alias("idf"))
    # numbers stand for names from here on; they are fixed by writing them
    rare = kept(rare.withColumn("i", F.monotonically_increasing_id()), "rare")
    # a document's rare entities: as many as the document has
    own = once.join(rare, "e").repartition(max(1, once.count() // ROWS), "d").groupBy("d").agg(F.array_sort(F.collect_list(F.struct("i", "idf", "strong"))).alias("es"))
    alike = F.sha2(F.to_json(F.struct(F.transform("es", lambda x: F.struct(x["i"].alias("i"), x["strong"].alias("s"))).alias("es"), "size")), 256)
    listed = kept(own.where(F.size("es") >= least_shared).join(size, "d").withColumn("k", alike), "listed")
    first = listed.select("k", "d").withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy("d"))).where(F.col("_n") <= most + 1)
    heads = first.groupBy("k").agg(F.min("d").alias("c"), F.array_sort(F.collect_list("d")).alias("ds"))
    classes = kept(listed.select("d", "es", "size").join(heads, F.col("d") == F.col("c")).drop("d"), "classes")

    # a class's best document is its smallest, so what is in the list is of the best classes
    best = lambda rows, by: rows.withColumn("n", F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), by))).where(F.col("n") <= most + 1)

    def ranked(sums: DataFrame) -> DataFrame:
        good = sums.where((F.col("shared") >= least_shared) & (F.col("strong") >= 1))
        return best(good.select("a", "b", "shared", F.round(F.col("weight") / F.log2(F.col("size") + 2), 6).alias("score")), "b").drop("n")

    total = lambda c, zero: F.aggregate("es", F.lit(zero), lambda t, x: t + x[c])
    itself = classes.select(F.col("c").alias("a"), F.col("c").alias("b"), "size", F.size("es").cast("long").alias("shared"), total("idf", 0.0).alias("weight"), total("strong", 0).cast("long").alias("strong"))
    scored = kept(ranked(_by_pairs(classes.where(F.size("es") <= WIDE), path)), "ranked").unionByName(ranked(itself))
    wide = classes.where(F.size("es") > WIDE)
    if not wide.isEmpty():
        single = wide.select(F.col("c").alias("a"), F.explode("es").alias("x")).select("a", "x.*")
        singles = classes.select(F.col("c").alias("b"), F.size("es").alias("n"), F.explode("es.i").alias("i"))
        one, parts = _joined(single, singles, "i", "b")
        counted = one.where("a != b").repartition(parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("shared"), F.sum("idf").alias("weight"), F.sum("strong").alias("strong"), F.max("n").alias("n"))
        counted = kept(counted.where(F.col("shared") >= least_shared), "counted")
        back = counted.where(F.col("n") <= WIDE).select(F.col("b").alias("a"), F.col("a").alias("b"), "shared", "weight", "strong")
        scored = scored.unionByName(ranked(counted.drop("n").unionByName(back).join(classes.select(F.col("c").alias("b"), "size"), "b")))
    targets = best(scored, "b").drop("n").join(classes.select(F.col("c").alias("b"), "ds"), "b").withColumn("target", F.explode("ds"))
    lists = best(targets, "target").groupBy("a").agg(F.array_sort(F.collect_list(F.struct("n", "target", "shared", "score"))).alias("list"))
    of_class = classes.select("k", F.col("c").alias("a")).join(lists, "a").drop("a")
    others = F.slice(F.filter("list", lambda x: x["target"] != F.col("d")), 1, most)
    each = listed.select("k", "d").join(of_class, "k").select(F.col("d").alias("source"), F.posexplode(others).alias("n", "x"))
    return each.select("source", "x.target", "x.shared", "x.score", (F.col("n") + 1).cast("long").alias("rank"))


#: A footer of related notes, between its marks.
FOOTER_BEGIN, FOOTER_END = "<!-- related begin -->", "<!-- related end -->"


def link_targets(notes: DataFrame) -> DataFrame:
    """TXT28: id, target of notes (id, path): the bare stem where only one note has it, else the path without its ending."""
    rows = notes.select("id", F.regexp_replace("path", r"\.md$", "").alias("bare"))
    rows = rows.withColumn("stem", F.substring_index("bare", "/", -1))
    counts = rows.groupBy("stem").agg(F.count("*").alias("n"))
    return rows.join(counts, "stem").select("id", F.when(F.col("n") > 1, F.col("bare")).otherwise(F.col("stem")).alias("target"))


def footers(notes: DataFrame, ranked: DataFrame, targets: DataFrame) -> DataFrame:
    """SNK8: notes (id, text) with their footer of related notes set, replaced or removed; `changed` tells where.

    ranked: of `related`; targets: of `link_targets`.
    """
    named = ranked.join(targets.select(F.col("id").alias("target"), F.col("target").alias("name")), "target")
    listed = named.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "name"))), lambda x: F.concat(F.lit("[["), x["name"], F.lit("]]"))), " · ").alias("links"))  # at most `most` a note
    block = F.concat(F.lit(FOOTER_BEGIN + "\n**Related:** "), F.col("links"), F.lit("\n" + FOOTER_END + "\n"))
    old = "(?s)" + re.escape(FOOTER_BEGIN) + ".*?" + re.escape(FOOTER_END) + r"\n?"
    has = F.col("text").contains(FOOTER_BEGIN)
    # no group references: a footer may hold a dollar
    replaced = F.concat(F.regexp_extract("text", "(?s)^(.*?)" + old, 1), block, F.regexp_extract("text", "(?s)^.*?" + old + "(.*)$", 1))
    added = F.concat(F.regexp_replace("text", r"\n+\z", ""), F.lit("\n\n"), block)
    new = F.when(F.col("links").isNotNull(), F.when(has, replaced).otherwise(added)).when(has, F.regexp_replace("text", old, "")).otherwise(F.col("text"))
    rows = notes.join(listed, F.col("id") == F.col("source"), "left")
    return rows.select("id", new.alias("new"), "text").select("id", F.col("new").alias("text"), (F.col("new") != F.col("text")).alias("changed"))


def unlinked(entity_rows: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """JN5."""
    return entity_rows.join(links.select(key).distinct(), key, "left_anti")


def votes(links: DataFrame, entity: str, fact: str, domain: str) -> DataFrame:
    """AGG25, JN3: distinct facts a domain."""
    return links.groupBy(entity, domain).agg(F.count_distinct(fact).alias("votes"))


#: Subject, verb, object; the predicate is the verb's name.
RELATIONS = {
    "runs_on": r"(?i)\b([\w-]+(?:-api|executor|proxy))\b\s+(?:runs?|deployed|scheduled)\s+(?:on|to)\s+(k8s-[\w-]+)",
    "uses_storage": r"(?i)\b([\w-]+)\s+(?:uses?|on|backed by)\s+(block-\w+)",
    "in_namespace": r"(?i)\b([\w-]+(?:-api|executor|proxy))\b\s+(?:in|namespace)\s+(\w+)\s+namespace",
}


def relations(docs: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str] = RELATIONS) -> DataFrame:
    """KG3: id, subject, predicate, object."""
    out = None
    for name, p in patterns.items():
        pairs = F.arrays_zip(F.regexp_extract_all(text_col, F.lit(p), 1).alias("s"), F.regexp_extract_all(text_col, F.lit(p), 2).alias("o"))
        own = docs.select(F.col(id_col).alias("id"), F.explode(F.transform(pairs, lambda x: F.struct(F.lower(x["s"]).alias("s"), F.lower(x["o"]).alias("o")))).alias("p"))
        own = own.select("id", F.col("p.s").alias("subject"), F.lit(name).alias("predicate"), F.col("p.o").alias("object"))
        out = own if out is None else out.unionByName(own)
    return out.distinct()


def find(entity_rows: DataFrame, triples: DataFrame, term: str, as_of=None) -> DataFrame:
    """KG10: entities whose name holds the term, with their edges from both ends; as_of: only edges valid then."""
    hits = entity_rows.where(F.lower("name").contains(term.lower())).select(F.col("entity_id").alias("entity"))
    edges = timeline(triples)
    if as_of is not None:
        t = F.lit(as_of).cast("timestamp")
        edges = edges.where((F.col("valid_from").isNull() | (F.col("valid_from") <= t)) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))
    return hits.join(edges, "entity")


def invalidate(triples: DataFrame, subject, predicate, obj, ended) -> DataFrame:
    """KG8: closes the open edge."""
    hit = (F.col("subject") == subject) & (F.col("predicate") == predicate) & (F.col("object") == obj) & F.col("valid_to").isNull()
    return triples.withColumn("valid_to", F.when(hit, F.lit(ended).cast("timestamp")).otherwise(F.col("valid_to")))


def index_new(docs: DataFrame, indexed: DataFrame, id_col: str, text_col: str, patterns: Mapping[str, str], most: int = vocab.PAIR_MOST, aliases: Mapping[str, str] = {}, stop: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """KG12, STR2: links, co-occurrence edges and dropped slots of texts that weren't indexed yet."""
    found = mentions(docs.join(indexed.select(id_col), id_col, "left_anti"), id_col, text_col, patterns, aliases, stop)
    return found.select("id", "entity_id"), *pair_up(found, most)


def add_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """KG6, STR2: weights of new edges added to the old ones'; the first fact stays the smallest."""
    both = old.select("subject", "predicate", "object", "weight", "first").unionByName(new)
    return both.groupBy("subject", "predicate", "object").agg(F.sum("weight").alias("weight"), F.min("first").alias("first"))
