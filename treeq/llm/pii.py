"""Personal data: fixed patterns, and bootstrapped contextual extraction, with DataFrame functions only.

Spans are kind:start:end in code points, end exclusive. The base kinds are found leftmost and without overlaps, each kind by
itself; matches that fail their check are dropped. Their patterns are written so that a search is linear in the text's length.

Kind "context" comes from a graph of lexical patterns and instances. A candidate is a run of identifier characters with a digit,
after a word. Its patterns are that word, lower-cased; the word with the shape of the run, in which 9 stands for digits and a for letters; and, if
there is another word before, the two words. Seeds are candidates that overlap a base span. A pattern's confidence is the
share of its different instances that are believed, smoothed; an instance is believed if it is a seed, else as much as its
patterns say together (noisy or). After ROUNDS rounds, patterns of MIN_SEEDS different seeds and MIN_CONFIDENCE discover: other candidates of
any of them become spans.

Texts are read once and never shuffled. Patterns are aggregated before they are shuffled, tables that are joined are written to
the shared folder, so that a frequent pattern can be split. Null and empty texts have no spans. Ids may be null or repeat:
candidates go back to the rows of their id and text. An input without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from treeq.llm.base import stored, table, text_or_empty, with_value

KINDS = ("email", "ip", "card", "phone", "context")
#: The contract's patterns. Possessive quantifiers and the test before a run keep them linear; \G lets a run go on where a match ended.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?+[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
NEEDS = ("@", ".", None, "+")
CANDIDATE = r"(?<!\p{L})(?:\p{L}++[:#]?+[\x20\t]++)?\p{L}++[:#]?+[\x20\t]++(?=[A-Za-z0-9._%+@/-]*[0-9])[A-Za-z0-9._%+@/-]{5,}+"
INSTANCE, BEFORE = r"[A-Za-z0-9._%+@/-]+$", r"^(?:\p{L}++[:#]?+[\x20\t]++){1,2}"
ROUNDS, MIN_SEEDS, MIN_CONFIDENCE, PRIOR, CHUNK = 2, 5, 0.8, 1.0, 128


def _luhn(digits: Column) -> Column:
    at = lambda i: F.substr(digits, -i, F.lit(1)).cast("int")
    double = lambda i: at(i) * 2 - F.when(at(i) > 4, 9).otherwise(0)
    values = F.transform(F.sequence(F.lit(1), F.char_length(digits)), lambda i: F.when(i % 2 == 0, double(i)).otherwise(at(i)))
    return F.aggregate(values, F.lit(0), lambda a, b: a + b) % 10 == 0


def _valid(kind: int, x: Column) -> Column:
    if kind == 1:
        bare = lambda p: F.ltrim(p, F.lit("0"))
        return F.forall(F.split(x, r"\."), lambda p: (F.char_length(bare(p)) < 3) | ((F.char_length(bare(p)) == 3) & (bare(p) <= "255")))
    digits = F.regexp_replace(x, "[^0-9]", "")
    if kind == 2:
        return F.when(F.char_length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False))
    return F.char_length(digits).between(9, 15) if kind == 3 else F.lit(True)


def _found(text: Column, pattern: str, needs: str | None) -> Column:
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>")) if needs else found


def _chunks(items: Column) -> Column:
    """An array in pieces of CHUNK, one at least: work that grows with the square of a piece, or with items times pieces, stays small."""
    last = F.greatest(F.ceil(F.size(items) / CHUNK).cast("int") - 1, F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * CHUNK + 1, F.lit(CHUNK)))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    """array<struct<start, end, x>>: matches lie between the parts that splitting at them leaves."""
    parts = F.split(text, pattern, -1)
    sizes = F.zip_with(F.slice(parts, 1, F.size(found)), found, lambda g, x: F.struct(F.char_length(g).alias("g"), F.char_length(x).alias("n"), x.alias("x")))
    none = F.array().cast("array<struct<start:int,end:int,x:string>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    add = lambda a, e: F.struct((a["at"] + e["g"] + e["n"]).alias("at"), F.array_append(a["out"], F.struct((a["at"] + e["g"]).alias("start"), (a["at"] + e["g"] + e["n"]).alias("end"), e["x"].alias("x"))).alias("out"))
    moved = lambda run, by: F.transform(run["out"], lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["x"].alias("x")))
    starts = lambda runs: F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda a, r: F.struct((a["at"] + r["at"]).alias("at"), F.array_append(a["out"], a["at"]).alias("out")), lambda a: a["out"])
    runs = with_value(sizes, lambda x: F.transform(_chunks(x), lambda chunk: F.aggregate(chunk, zero, add)))
    many = with_value(runs, lambda r: F.flatten(F.zip_with(r, starts(r), moved)))
    return F.when(F.size(found) == 0, none).when(F.size(found) <= CHUNK, F.aggregate(sizes, zero, add, lambda a: a["out"])).otherwise(many)


def _spans(kind: int, placed: Column) -> Column:
    return F.transform(F.filter(placed, lambda s: _valid(kind, s["x"])), lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))


def _patterns(before: Column, instance: Column) -> Column:
    """The patterns of a candidate; the number in front tells their kinds apart."""
    word = F.substring_index(before, " ", -1)
    shape = F.regexp_replace(F.regexp_replace(instance, "[A-Za-z]+", "a"), "[0-9]+", "9")
    both = F.when(F.contains(before, F.lit(" ")), F.concat(F.lit("2 "), before))
    return F.array_compact(F.array(F.concat(F.lit("1 "), word), both, F.concat(F.lit("3 "), word, F.lit(" "), shape)))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, candidates) of every row. base: array<struct<start, kind, end>> in order; candidates: array<struct<patterns, instance, start, end, seed>>."""
    df = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    every = [*zip(PATTERNS, NEEDS, strict=True), (CANDIDATE, None)]
    df = df.select("doc_id", "text", *(_found(F.col("text"), p, needs).alias(f"m{k}") for k, (p, needs) in enumerate(every)))
    df = df.select("doc_id", F.xxhash64("text").alias("text_hash"), *(_placed(F.col("text"), p, F.col(f"m{k}")).alias(f"p{k}") for k, (p, _) in enumerate(every)))
    spans = F.array_sort(F.concat(*(_spans(k, F.col(f"p{k}")) for k in range(4))))
    df = df.select("doc_id", "text_hash", spans.alias("base"), "p4")
    near = F.transform(_chunks(F.col("base")), lambda c: F.struct(c.alias("spans"), F.array_min(F.transform(c, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(c, lambda s: s["end"])).alias("hi")))

    def candidate(near: Column, x: Column, end: Column, instance: Column) -> Column:
        start = end - F.char_length(instance)
        before = F.lower(F.regexp_replace(F.rtrim(F.regexp_extract(x, BEFORE, 0), F.lit(" \t")), r"[\x20\t]+", " "))
        meets = lambda at: F.exists(near, lambda c: (c["lo"] < end) & (at < c["hi"]) & F.exists(c["spans"], lambda s: (s["start"] < end) & (at < s["end"])))
        return F.struct(_patterns(before, instance).alias("patterns"), instance.alias("instance"), start.alias("start"), end.alias("end"), F.coalesce(with_value(start, meets), F.lit(False)).alias("seed"))

    candidates = with_value(near, lambda n: F.transform("p4", lambda c: with_value(F.regexp_extract(c["x"], INSTANCE, 0), lambda i: candidate(n, c["x"], c["end"], i))))
    return df.select("doc_id", "text_hash", "base", candidates.alias("candidates"))


def confident(edges: DataFrame) -> DataFrame:
    """edges (pattern, instance, seed), all different pairs -> (pattern) that may discover."""
    believed = edges.select("pattern", "instance", "seed", F.col("seed").cast("double").alias("belief"))
    for k in range(ROUNDS):
        scored = believed.groupBy("pattern").agg((F.sum("belief") / (F.count(F.lit(1)) + PRIOR)).alias("confidence"), F.count_if("seed").alias("seeds"))
        scored = stored(scored, "patterns")
        if k + 1 < ROUNDS:
            lessons = edges.where(~F.col("seed")).join(scored, "pattern").groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("told"))
            believed = edges.join(stored(lessons, "instances"), "instance", "left").select("pattern", "instance", "seed", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("told", F.lit(0.0))).alias("belief"))
    return scored.where((F.col("seeds") >= MIN_SEEDS) & (F.col("confidence") >= MIN_CONFIDENCE)).select("pattern")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, spans) of every row: array<struct<start, kind, end>>; spans: base and discovered ones."""
    found = stored(base(docs, id_col, text_col), "spans")
    seen = stored(found.where(F.size("candidates") > 0).select("doc_id", "text_hash", F.explode("candidates").alias("c")).select("doc_id", "text_hash", "c.instance", "c.start", "c.end", "c.seed", F.explode("c.patterns").alias("pattern")), "candidates")
    edges = stored(seen.groupBy("pattern", "instance").agg(F.bool_or("seed").alias("seed")), "edges")
    new = seen.where(~F.col("seed")).join(stored(confident(edges), "confident"), "pattern")
    span = F.struct("start", F.lit(len(KINDS) - 1).alias("kind"), "end")
    new = new.groupBy("doc_id", "text_hash").agg(F.collect_set(span).alias("new")).select(F.col("doc_id").alias("new_id"), F.col("text_hash").alias("new_hash"), "new")
    met = found.join(stored(new, "new"), F.col("doc_id").eqNullSafe(F.col("new_id")) & (F.col("text_hash") == F.col("new_hash")), "left")
    return met.select("doc_id", "base", F.when(F.col("new").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "new"))).alias("spans"))


def written(spans: str) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    found = find(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(4)), F.sha2(written("base"), 256).alias("base_sha256"), written("spans").alias("spans"))


QUERIES = {"op7_pii": op7_pii}
ORACLE: dict[str, str] = {}
