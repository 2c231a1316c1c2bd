"""Secret scans with a random forest that takes out false positives.

A candidate is

* a value of 8 characters or more, with any punctuation but quotes, that is assigned
  to a name of credentials, quoted or not;
* a key of letters or digits after a known prefix;
* a run of 24 letters or more that changes from small to capital three times;
* any other run of at least 16 characters ``[A-Za-z0-9+/_=-]`` with a digit in it.

Labelled findings train a random forest on

* the candidate's length and make-up (shares of digits, capitals and hex digits);
* its character transitions: changes between kinds of characters, and the mean
  log probability of its letter pairs under the corpus's own words;
* dictionary coverage: the share of its characters in letter runs that are
  frequent words of the corpus;
* its path: the document's source, and whether it stands in a path;
* its neighbouring words: two before and one after, hashed, without names of
  credentials.

What the labels of ``label_findings`` are made from (the name, the assignment, the
quote, the address) is no feature, but for words like commit, which are neighbouring
words.

The forest's verdict replaces the rule that made the candidate. Everything runs
as built-in functions and ``pyspark.ml``; the forest is fitted on at most
``MAX_TRAIN`` labelled findings in hash order, all else covers all documents.

Defined cases: a null or empty text has no findings; a null source is a source
of its own; rows that repeat a doc_id, a null one too, are scanned each, and equal rows
are judged alike, however often they occur; texts and candidates of any length are read
whole; without labelled findings of both kinds there is no forest: score is null and all
findings stay; an empty table gives an empty result; further columns are not looked at.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefixdex.llm import tables

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])[A-Za-z0-9+/_=-]{16,}"
NAME = r"(?:token|secret|api[_-]?key|access[_-]?key|private[_-]?key|password|passwd|pwd|credential)"
#: A name, what stands between it and its value, and the value.
ASSIGNED = rf"(?i:{NAME}[\w-]{{0,30}}[\"']?[ \t]{{0,8}}(?::=|=>|[=:])[ \t]{{0,8}}[\"']?)"
VALUE = r"[^\s\"'`<>(){}\[\],;]{8,}"
PREFIXED = r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|gh[opsu]_|github_pat_|glpat-|[sr]k_live_|sk-|xox[abps]-)[A-Za-z0-9_-]{12,}"
LETTERS = r"(?<![A-Za-z0-9+/_=-])(?=(?:[A-Za-z]*?[a-z][A-Z]){3})[A-Za-z]{24,}(?![A-Za-z0-9+/_=-])"
ANY = rf"({ASSIGNED})({VALUE})|({PREFIXED}|{CANDIDATE}|{LETTERS})"
#: What stands before a revision or a checksum; and a UUID.
SUM = r"(?i)(?:commit|revision|checksum|digest|etag|hash|md5|sha-?[0-9]{0,3})[\s=:\"'#/-]{1,8}$"
UUID = r"(?i)^[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$"
MAX_TRAIN = 20_000
TREES, DEPTH, SEED = 20, 8, 11
MIN_COUNT = 20  # of a dictionary word
AROUND = 60  # characters kept at either side
HASHED = 32  # places for neighbouring words
SOURCES = 16  # places for sources
CUTOFF = 0.5
_MARK = "\u0001"


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, source, start (code points), candidate, before and after of every
    candidate of every document row."""
    rows = docs.where(F.col("text").rlike(ANY)).select(F.col("doc_id").cast("long"), "source", F.translate("text", _MARK, " ").alias("body"))
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    marked = F.regexp_replace("body", ANY, f"$1{_MARK}$2$3{_MARK}")
    parts = rows.select("row", "doc_id", "source", F.posexplode(F.split(marked, _MARK, -1)).alias("i", "part"))
    # Texts between candidates are cut to what is looked at, before they are sorted.
    found = F.col("i") % 2 == 1
    narrow = parts.select(
        "row", "doc_id", "source", "i", F.length("part").alias("n"),
        F.when(found, F.col("part")).alias("candidate"),
        F.when(~found, F.substring("part", -AROUND, AROUND)).alias("tail"),
        F.when(~found, F.substring("part", 1, AROUND)).alias("head"),
    )
    w = Window.partitionBy("row").orderBy("i")
    placed = narrow.select(
        "doc_id", "source", "candidate",
        F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"),
        F.coalesce(F.lag("tail").over(w), F.lit("")).alias("before"),
        F.coalesce(F.lead("head").over(w), F.lit("")).alias("after"),
    )
    return placed.where("candidate is not null")


def dictionary(docs: DataFrame, min_count: int = MIN_COUNT) -> DataFrame:
    """(word, n): words of three ASCII letters or more found at least ``min_count``
    times in the corpus."""
    found = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") >= 3)
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def _pairs(text: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(text, i, F.lit(2)))


def transitions(words: DataFrame) -> DataFrame:
    """(pair, logp): log probability of the second letter after the first, over the
    dictionary's words by their counts; at most 26 x 26 rows."""
    pairs = words.select(F.explode(_pairs(F.col("word"))).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("n"))
    firsts = pairs.groupBy(F.substring("pair", 1, 1).alias("first")).agg(F.sum("n").alias("whole"))
    both = pairs.withColumn("first", F.substring("pair", 1, 1)).join(F.broadcast(firsts), "first")
    return both.select("pair", F.log((F.col("n") + 0.5) / (F.col("whole") + 13)).alias("logp"))


def _share(pattern: str) -> Column:
    c = F.col("candidate")
    return F.length(F.regexp_replace(c, pattern, "")) / F.length(c)


FEATURES = ["length", "digits", "capitals", "hex", "changes", "pair_logp", "paired", "coverage", "in_path"]


def features(found: DataFrame, words: DataFrame, moves: DataFrame) -> DataFrame:
    """``found`` with one column for each feature and the vector of all."""
    c = F.col("candidate")
    # What depends on the candidate alone is found once for each distinct one.
    rows = found.withColumn("id", F.unhex(F.md5(c.cast("binary"))))
    distinct = rows.select("id", F.lower(c).alias("lowered")).dropDuplicates(["id"])
    pairs = distinct.select("id", F.explode(F.array_distinct(_pairs(F.col("lowered")))).alias("pair")).where(F.col("pair").rlike("^[a-z]{2}$"))
    pairs = pairs.join(F.broadcast(moves), "pair", "left").groupBy("id")
    pairs = pairs.agg(F.avg(F.coalesce("logp", F.lit(-12.0))).alias("pair_logp"), F.count(F.lit(1)).alias("n_pairs"))
    runs = distinct.select("id", F.explode(F.regexp_extract_all("lowered", F.lit("[a-z]{3,}"), F.lit(0))).alias("word"))
    runs = runs.join(words.select("word"), "word").groupBy("id").agg(F.sum(F.length("word")).alias("covered"))
    rows = rows.join(pairs, "id", "left").join(runs, "id", "left")
    kinds = F.regexp_replace(c, "[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+", "x")
    before, after = F.split(F.trim("before"), r"[\s=:\"']+"), F.split(F.trim("after"), r"[\s=:\"']+")
    near = [F.element_at(before, -1), F.try_element_at(before, F.lit(-2)), F.element_at(after, 1)]
    near = [F.when(~x.rlike(f"(?i){NAME}"), x) for x in near]
    places = F.array(*[F.pmod(F.xxhash64(F.lit(k), F.lower(F.coalesce(x, F.lit("")))), F.lit(HASHED)) for k, x in enumerate(near)])
    rows = rows.select(
        "doc_id", "source", "start", "candidate", "before", "after",
        F.length(c).cast("double").alias("length"),
        _share("[^0-9]").alias("digits"), _share("[^A-Z]").alias("capitals"), _share("[^0-9a-f]").alias("hex"),
        ((F.length(kinds) - 1) / F.length(c)).alias("changes"),
        F.coalesce("pair_logp", F.lit(0.0)).alias("pair_logp"),
        (F.coalesce("n_pairs", F.lit(0)) / F.length(c)).alias("paired"),
        F.least(F.lit(1.0), F.coalesce("covered", F.lit(0)) / F.length(c)).alias("coverage"),
        (F.col("before").rlike(r"[\\/.]$") | c.contains("/")).cast("double").alias("in_path"),
        F.col("before").rlike(r"(?i)(https?://|www\.|@)\S*$").cast("double").alias("in_address"),
        places.alias("near"),
        F.pmod(F.xxhash64(F.coalesce("source", F.lit("\u0000"))), F.lit(SOURCES)).alias("place"),
    )
    hashed = F.transform(F.sequence(F.lit(0), F.lit(HASHED - 1)), lambda k: F.array_contains("near", k.cast("long")).cast("double"))
    of_source = F.transform(F.sequence(F.lit(0), F.lit(SOURCES - 1)), lambda k: (F.col("place") == k).cast("double"))
    numbers = F.array(*[F.col(f).cast("double") for f in FEATURES])
    return rows.withColumn("features", array_to_vector(F.concat(numbers, hashed, of_source))).drop("near", "place")


def label_findings(rows: DataFrame) -> DataFrame:
    """Findings that a precise rule can label: 1 where a value is assigned to a name
    of credentials, quoted or not, and has a digit beside a letter or 20 characters
    or more; 0 for digits alone, for what stands in an address and, where no such name
    does, for hex digits after a word like commit or checksum and for UUIDs. All others
    have no label and are dropped."""
    named = F.col("before").rlike(f"{ASSIGNED}$")
    true = named & (F.col("candidate").rlike("(?=.*[0-9]).*[A-Za-z]") | (F.length("candidate") >= 20))
    summed = F.col("before").rlike(SUM) & F.col("candidate").rlike("^[0-9A-Fa-f]+$")
    false = F.col("candidate").rlike("^[0-9-]+$") | (F.col("in_address") == 1) | (~named & (summed | F.col("candidate").rlike(UUID)))
    return rows.withColumn("label", F.when(true, 1.0).when(false, 0.0)).where("label is not null")


def train(labelled: DataFrame) -> RandomForestClassificationModel | None:
    """A forest on ``features`` and ``label``; None unless both labels occur."""
    order = F.xxhash64("doc_id", "start", "candidate")
    # Like findings of either label, each from its own hash order.
    sample = labelled.where("label = 1").orderBy(order).limit(MAX_TRAIN // 2)
    sample = sample.unionByName(labelled.where("label = 0").orderBy(order).limit(MAX_TRAIN // 2))
    sample = tables.save(sample.select("features", "label"), "labelled")
    if sample.select("label").distinct().count() < 2:
        return None
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(sample)


def judge(rows: DataFrame, model: RandomForestClassificationModel | None, cutoff: float = CUTOFF) -> DataFrame:
    if model is None:
        return rows.withColumn("score", F.lit(None).cast("double")).withColumn("is_secret", F.lit(True))
    scored = model.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return scored.withColumn("is_secret", F.col("score") >= cutoff).drop("rawPrediction", "probability", "prediction")


def scan(docs: DataFrame, labelled: DataFrame | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """All candidates of ``docs`` with their features, score and is_secret.
    ``labelled`` (doc_id, start, label) gives the labels of findings; without it
    the precise rule labels those it can."""
    words = tables.save(dictionary(docs, min_count), "dictionary")
    moves = tables.save(transitions(words), "transitions")
    rows = tables.save(features(tables.save(candidates(docs), "candidates"), words, moves), "findings")
    known = label_findings(rows) if labelled is None else rows.join(labelled.select("doc_id", "start", F.col("label").cast("double").alias("label")), ["doc_id", "start"])
    return judge(rows, train(known))
