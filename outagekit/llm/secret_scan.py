"""Secret scan with a random forest against false positives (operator 6).

Candidates are runs of 12 or more key characters inside the words of a text
(a word may wrap one in quotes, an assignment or a url).  Each has features:
length; shares of digits, capitals and hexadecimal characters and of distinct
characters; transitions between lower case, capitals, digits and signs;
dictionary coverage - the share of its letters in runs that are words of the
corpus; path - what stands around it in its word (slashes, ``@``, dots, a
url scheme, an assignment); and the neighbouring words - whether the three
before name a credential, assign, or are plain.  A random forest (Spark ML)
is trained on labelled findings and gives every candidate a probability.

``labelled_findings`` labels what well-known formats settle: issued key
formats and assigned random values are secrets; words, identifiers, addresses
and numbers are not; the rest stays unlabelled.  Findings labelled by hand can
be passed instead.  The forest is fitted to about ``sample`` findings of
each label at most (never over twice that), picked by a hash; counts and
scores cover all rows.

Defined results: null and empty texts have no candidates; repeated rows have
their candidates each; without findings of both labels the probability is the
share of secrets among the labelled (0 without any); an empty table gives an
empty result; other columns are never read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from outagekit.llm.common import WORD, cut, located, table
from outagekit.operators.joins import broadcast_bounded

KEY = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
LETTERS = r"[A-Za-z]{3,}"
#: Times a run of letters must stand as a word in the corpus to count as one.
KNOWN = 5
SAMPLE, TREES, DEPTH, SEED = 5000, 24, 6, 11
# Issued key formats and the names that credentials are assigned to.
ISSUED = r"^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk_live_[A-Za-z0-9]{16,}|xox[abpr]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35})$"
NAMES = r"(?i)(password|passwd|pwd|token|secret|api[_-]?key|apikey|credential|auth)"
FEATURES = ["length", "digits", "capitals", "hexes", "distinct", "transitions", "coverage",
            "slashes", "at_sign", "dots", "scheme", "assigned", "named_before", "assign_before", "plain_before"]


def _share(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern)) / F.length(c)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, __f, __row, place (of the word, from 0), candidate, word and
    the words ``b3``, ``b2``, ``b1`` before it."""
    d = located(docs.select("doc_id", "text")).withColumn("__f", F.xxhash64("__file")).where(F.col("text").rlike(KEY))
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    one = d.select("doc_id", "__f", "__row", F.inline(F.array(F.struct(words.alias("w")))))
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.element_at("w", i + 1).rlike(KEY))
    two = one.where(F.size("w") > 0).select("doc_id", "__f", "__row", "w", F.explode(places).alias("place"))

    def at(back: int) -> Column:
        return F.when(F.col("place") >= back, F.element_at("w", F.col("place") - back + 1)).otherwise(F.lit(""))

    three = two.select("doc_id", "__f", "__row", "place", at(0).alias("word"), at(3).alias("b3"), at(2).alias("b2"), at(1).alias("b1"))
    return three.select("*", F.posexplode(F.regexp_extract_all("word", F.lit(f"({KEY})"))).alias("nth", "candidate"))


def dictionary(docs: DataFrame, runs: DataFrame, known: int = KNOWN) -> DataFrame:
    """The distinct ``run`` of letters that stand ``known`` times or more as
    words of the texts.  Every word of the corpus is looked up among the runs."""
    w = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z0-9+/_\-])([a-z]{3,})(?![a-z0-9+/_\-])"))).alias("run"))
    return (w.join(broadcast_bounded(runs), "run", "left_semi").groupBy("run").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= known).select("run"))


def features(docs: DataFrame) -> DataFrame:
    """Candidates with the columns of FEATURES."""
    c = cut(candidates(docs))
    ids = ["doc_id", "__f", "__row", "place", "nth"]
    # distinct candidates: a copied secret is looked up once
    texts = c.select("candidate").distinct()
    runs = texts.select("candidate", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit("([a-z]{3,})"))).alias("run"))
    words = cut(dictionary(docs, runs.select("run").distinct()))
    covered = (runs.join(broadcast_bounded(words), "run").groupBy("candidate").agg(F.sum(F.length("run")).alias("covered")))
    letters = F.regexp_count("candidate", F.lit("[A-Za-z]"))
    k, w = F.col("candidate"), F.col("word")
    turns = F.regexp_count(k, F.lit(r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Z])|(?<=[0-9])(?=[^0-9])|(?<=[+/_=\-])(?=[^+/_=\-])"))
    before = F.concat_ws(" ", "b3", "b2", "b1")
    flag = lambda x: x.cast("double")
    out = texts.join(covered, "candidate", "left").select(
        "candidate", F.length(k).cast("double").alias("length"), _share(k, "[0-9]").alias("digits"),
        _share(k, "[A-Z]").alias("capitals"), _share(k, "[0-9a-f]").alias("hexes"),
        (F.size(F.array_distinct(F.split(k, ""))) / F.length(k)).alias("distinct"),
        (turns / F.length(k)).alias("transitions"),
        F.when(letters > 0, F.coalesce("covered", F.lit(0)) / letters).otherwise(F.lit(0.0)).alias("coverage"))
    return c.join(out, "candidate").select(
        *ids, "candidate", "word", "b3", "b2", "b1", *FEATURES[:7],
        F.regexp_count(w, F.lit("/")).cast("double").alias("slashes"), flag(w.contains("@")).alias("at_sign"),
        F.regexp_count(w, F.lit(r"\.(?=\w)")).cast("double").alias("dots"), flag(w.contains("://")).alias("scheme"),
        flag(w.rlike(r"[A-Za-z_][=:]['\"]?[A-Za-z0-9]")).alias("assigned"), flag(before.rlike(NAMES) | w.rlike(NAMES)).alias("named_before"),
        flag(before.rlike(r"[=:]['\"]?$")).alias("assign_before"), flag(F.col("b1").rlike(r"^[A-Za-zÀ-ÿ]+[.,;]?$")).alias("plain_before"))


def labelled_findings(found: DataFrame) -> DataFrame:
    """``found`` (features) with ``label``: 1 and 0 where a format settles it."""
    k = F.col("candidate")
    random = k.rlike("[0-9]") & k.rlike("[A-Za-z]") & (F.col("distinct") * F.col("length") >= 6)
    given = ((F.col("assigned") == 1) | (F.col("assign_before") == 1)) & (F.col("named_before") == 1) & random
    wordy = ~k.rlike("[0-9]") & (F.col("capitals") < 0.2)
    uuid = k.rlike(r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
    number = k.rlike(r"^[0-9+/_\-]+=*$")
    address = (F.col("at_sign") == 1) | (F.col("scheme") == 1)
    return found.withColumn("label", F.when(k.rlike(ISSUED) | (given & ~address), F.lit(1.0))
                            .when(wordy | uuid | number | address, F.lit(0.0)))


def scan(docs: DataFrame, findings: DataFrame | None = None, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH,
         threshold: float = 0.5) -> DataFrame:
    """One row per candidate: doc_id, place, nth, candidate, the features,
    probability, is_secret, __f, __row.  ``findings``: rows with FEATURES and
    ``label`` (default: what the formats label)."""
    found = cut(features(docs))
    labelled = cut((labelled_findings(found) if findings is None else findings).where("label is not null")
                   .select(*FEATURES, "label").distinct())
    n, ones = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    share = {1.0: -(-int(ones) // sample), 0.0: -(-int(n - ones) // sample)}  # one finding in so many, by its hash
    if n == 0 or ones in (0, n):
        scored = found.withColumn("probability", F.lit(float(ones / n) if n else 0.0))
    else:
        h = F.xxhash64(*FEATURES)
        chosen = [labelled.where((F.col("label") == v) & (F.pmod(h, F.lit(share[v])) == 0)).limit(2 * sample) for v in (0.0, 1.0)]
        as_vector = VectorAssembler(inputCols=FEATURES, outputCol="__features")
        forest = RandomForestClassifier(featuresCol="__features", labelCol="label", numTrees=trees, maxDepth=depth, seed=SEED,
                                        probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__prediction")
        train = cut(chosen[0].unionByName(chosen[1]).coalesce(1).sortWithinPartitions("label", h, *FEATURES))
        model = forest.fit(as_vector.transform(train))
        scored = model.transform(as_vector.transform(found)).withColumn("probability", vector_to_array("__p")[1])
    return scored.select("doc_id", "place", "nth", "candidate", *FEATURES, "probability",
                         (F.col("probability") >= threshold).alias("is_secret"), "__f", "__row")


def op6_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "place", "nth", "candidate", "probability", "is_secret")
