"""Secrets in text: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_insight.llm.common import whole
from retail_insight.sources.workspace import stage

CANDIDATE = r"[A-Za-z0-9_+/\-]{12,}={0,2}"
# Formats that issuers give their keys, and words that name a secret.
ISSUED = r"^(AKIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abpr]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35})$"
NAMED = r"(?i)(token|passw|pwd|secret|api_?key|auth|bearer|credential|private)"
FEATURES = (
    "length digits upper lower transitions distinct coverage hexadecimal "
    "slashes before_name before_sign quoted path_sign near_name after_word"
).split()


def dictionary(docs: DataFrame, text: str, size: int) -> list[str]:
    """The ``size`` most frequent words of three or more letters, over all texts."""
    words = docs.select(F.explode(F.split(F.lower(whole(text)), r"[^a-z]+")).alias("word"))
    counted = words.where("length(word) BETWEEN 3 AND 12").groupBy("word").agg(F.count("*").alias("n"))
    return [r[0] for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def candidates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every long run that might be a secret, with its place and its neighbours.

    ``word_index`` counts the text's words from 0, ``part`` the candidates
    inside the word. ``path`` is the word around the candidate.
    """
    words = F.split(whole(text), r"[\x20\x09-\x0D]+")
    likely = r"(?=[^\s]*[0-9])[A-Za-z0-9_+/\-]{12,}|[A-Za-z0-9_+/\-]{20,}"
    places = F.filter(
        F.sequence(F.lit(0), F.size("words") - 1),
        lambda i: (F.length(F.get("words", i)) >= 12) & F.get("words", i).rlike(likely),
    )
    word = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    around = F.transform(
        places,
        lambda i: F.struct(
            i.alias("word_index"),
            F.when(i >= 2, word(F.greatest(i - 2, F.lit(0)))).otherwise(F.lit("")).alias("before2"),
            F.when(i >= 1, word(F.greatest(i - 1, F.lit(0)))).otherwise(F.lit("")).alias("before"),
            word(i).alias("path"),
            word(i + 1).alias("after"),
        ),
    )
    each = (
        docs.select(F.col(doc_id).alias("doc_id"), words.alias("words"))
        .select("doc_id", F.explode(around).alias("w"))
        .select("doc_id", "w.*")
    )
    return each.select(
        "*", F.posexplode(F.regexp_extract_all("path", F.lit(f"({CANDIDATE})"), F.lit(1))).alias("part", "candidate")
    ).where(F.col("candidate").rlike(r"[0-9]|^.{20,}$"))


def described(found: DataFrame, words: list[str]) -> DataFrame:
    """The candidates with the columns of ``FEATURES``."""
    length = F.length("candidate")

    def share(pattern: str) -> Column:
        return F.regexp_count("candidate", F.lit(pattern)) / length

    changes = r"(?<=[a-z])(?=[A-Z0-9])|(?<=[A-Z])(?=[a-z0-9])|(?<=[0-9])(?=[A-Za-z])"
    known = f"(?i){'|'.join(words)}" if words else r"(?!)"
    lead = F.expr("substring_index(path, candidate, 1)")
    columns = {
        "length": length,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "transitions": share(changes),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / length,
        "coverage": F.lit(1.0) - F.length(F.regexp_replace("candidate", known, "")) / length,
        "hexadecimal": F.col("candidate").rlike("^[0-9a-f]+$"),
        "slashes": share("[/_-]"),
        "before_name": lead.rlike(NAMED),
        "before_sign": lead.rlike("[=:]"),
        "quoted": lead.rlike("[\"'`]$"),
        "path_sign": F.col("path").rlike("[@]|://|\\.[a-z]{2,4}(/|$)"),
        "near_name": F.concat_ws(" ", "before2", "before").rlike(NAMED),
        "after_word": F.col("after").rlike("^[a-z]+[.,;]?$"),
    }
    return found.withColumns({n: c.cast("double") for n, c in columns.items()})


def label_by_format(found: DataFrame) -> DataFrame:
    """Labels from formats: 1 issued or assigned to a secret's name, 0 plainly something else, else null."""
    random_like = F.col("candidate").rlike("[0-9]") & F.col("candidate").rlike("[A-Za-z]")
    named = (F.col("before_name") + F.col("near_name") > 0) & ((F.col("before_sign") > 0) | F.col("before").rlike("^[=:]+$"))
    secret = F.col("candidate").rlike(ISSUED) | (named & random_like)
    other = (
        F.col("candidate").rlike(r"^[0-9-]+$")
        | (F.col("path_sign") > 0)
        | ~F.col("candidate").rlike("[0-9]")
        | F.col("candidate").rlike(r"^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    )
    return found.withColumn("label", F.when(secret, 1.0).when(other, 0.0))


def scan_secrets(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    labelled: DataFrame | None = None,
    trees: int = 30,
    depth: int = 6,
    training_rows: int = 20_000,
    dictionary_size: int = 300,
    threshold: float = 0.5,
    seed: int = 11,
) -> DataFrame:
    """Every candidate with its place, ``score`` and ``secret``.

    ``labelled`` findings have ``doc_id``, ``word_index``, ``part`` and
    ``label`` (0 or 1); without it, labels come from ``label_by_format``. A
    forest learns, from the first ``training_rows`` labelled findings of each
    class by a hash of their place, which length, character changes, coverage
    by frequent words, surrounding word and neighbours make a false positive;
    it then scores all candidates of all texts. The rows of a class that has
    more are weighed up to its size, so rare secrets all count and the scores
    are those of the classes as they are.

    Null texts count as empty and have no candidates; rows that repeat an id
    come out as often; other columns are not used. With labels of one class
    only among all of them, or none, every candidate scores that class (1.0
    without any). No rows give no rows.
    """
    words = dictionary(docs, text, dictionary_size)
    found = stage(described(candidates(docs, doc_id, text), words), "candidates")
    if labelled is None:
        known = label_by_format(found)
    else:
        place = ["doc_id", "word_index", "part"]
        known = found.join(labelled.groupBy(*place).agg(F.max("label").cast("double").alias("label")), place)
    counts = known.where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("n"))
    sizes = {r["label"]: r["n"] for r in counts.orderBy("label").collect()}  # of 0 and 1
    classes = list(sizes)
    kept = ["doc_id", "word_index", "part", "candidate"]
    if len(classes) < 2:
        scored = found.withColumn("score", F.lit(classes[0] if classes else 1.0))
    else:
        firsts = [
            known.where(F.col("label") == label)
            .orderBy(F.xxhash64("doc_id", "word_index", "part", "candidate"), "candidate")
            .limit(training_rows)
            .select("label", F.lit(max(1.0, n / training_rows)).alias("weight"), *FEATURES)
            for label, n in sizes.items()
        ]
        train = stage(reduce(DataFrame.unionAll, firsts).coalesce(1), "training")
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(
            featuresCol="features",
            labelCol="label",
            weightCol="weight",
            numTrees=trees,
            maxDepth=depth,
            featureSubsetStrategy="0.5",
            seed=seed,
        ).fit(assembler.transform(train))
        scored = forest.transform(assembler.transform(found)).withColumn(
            "score", F.round(F.element_at(vector_to_array("probability"), 2), 9)
        )
    return scored.select(*kept, "score", (F.col("score") >= threshold).alias("secret"))
