"""URL filter: host and path rules, and logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.functions.arrays import let
from pairloom.llm.tables import ascii_lower

#: Hash buckets, n-gram lengths, and the most rows that the regression is fitted on.
BUCKETS, GRAMS, TRAIN_ROWS = 1 << 18, (3, 4, 5), 5000


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(line: str) -> Rule:
    """A rule from text such as ``block example.com/en/``."""
    verdict, place = line.split(" ", 1)
    host, slash, path = place.partition("/")
    return Rule(verdict, host, slash + path)


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def first_rule(rules: Sequence[Rule], of_host: Column, of_path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null without one.

    Rules are few and belong to the job, so they become part of the expression: no join.
    """
    ranked = sorted(rules, key=lambda r: (-len(r.name), r.name))
    fits = lambda r: ((of_host == r.host) | of_host.endswith("." + r.host)) & of_path.startswith(r.path)
    pick = lambda what: (F.coalesce(*[F.when(fits(r), F.lit(what(r))) for r in ranked])
                         if ranked else F.lit(None).cast("string"))
    return pick(lambda r: r.name), pick(lambda r: r.verdict)


def grams(of_host: Column, of_path: Column, lengths: Sequence[int] = GRAMS) -> Column:
    """Character n-grams of host and path, marked by the part they are from."""
    def cut(mark: str, c: Column) -> Column:
        # Characters are cut once; a substring per place would walk the text again for each.
        def of_length(chars, n):
            def gram(i):
                return F.concat(F.lit(mark), *[F.coalesce(F.get(chars, i + j), F.lit("")) for j in range(n)])
            return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(chars) - n)), gram)

        def joined(chars):
            return F.flatten(F.array(*[of_length(chars, n) for n in lengths]))
        return let(F.split(F.concat(F.lit("^"), c, F.lit("$")), ""), joined)
    return F.array_distinct(F.concat(cut("h", of_host), cut("p", of_path)))


def train(labelled: DataFrame, url: str = "url", label: str = "label", rows: int = TRAIN_ROWS) -> PipelineModel | None:
    """Fit the regression on a small table of urls with labels 1 (block) and 0 (allow).

    At most ``rows`` rows are used, those with the smallest hash of the url; rows with a null
    url or label are left out.  None if there are not both labels.
    """
    sample = (labelled.select(F.col(url).alias("_url"), F.col(label).cast("double").alias("label")).dropna()
              .orderBy(F.xxhash64("_url"), "_url").limit(rows))
    sample = sample.select(grams(host(F.col("_url")), path(F.col("_url"))).alias("_grams"), "label").persist()
    try:
        n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
        if len(n) < 2:
            return None
        # Both labels weigh alike, whatever their numbers.
        share = F.when(F.col("label") == 1, sum(n.values()) / (2 * n[1.0])).otherwise(sum(n.values()) / (2 * n[0.0]))
        stages = [HashingTF(inputCol="_grams", outputCol="_features", numFeatures=BUCKETS, binary=True),
                  LogisticRegression(featuresCol="_features", labelCol="label", weightCol="_weight", regParam=0.001, maxIter=40,
                                     predictionCol="_label", probabilityCol="_odds", rawPredictionCol="_raw")]
        return Pipeline(stages=stages).fit(sample.withColumn("_weight", share))
    finally:
        sample.unpersist()


def judge(pages: DataFrame, rules: Sequence[Rule], model: PipelineModel | None, url: str = "url") -> DataFrame:
    """Verdict for every url: columns _host, _path, _rule, _verdict, _odds (of block) are added.

    A fitting rule decides; else the regression blocks at odds of one half or more.  Without a
    model, and for urls with neither host nor path (null, or no ``://``), the answer is allow.
    One pass without a shuffle; repeated rows get equal answers.
    """
    cut = pages.withColumn("_host", host(F.col(url))).withColumn("_path", path(F.col(url)))
    if model is None:
        odds = cut.withColumn("_block", F.lit(0.0))
    else:
        scored = model.transform(cut.withColumn("_grams", grams(F.col("_host"), F.col("_path"))))
        odds = scored.withColumn("_block", vector_to_array("_odds")[1])
    name, verdict = first_rule(rules, F.col("_host"), F.col("_path"))
    blank = (F.col("_host") == "") & (F.col("_path") == "")
    method = F.when(~blank & (F.col("_block") >= 0.5), "block").otherwise("allow")
    return (odds.withColumn("_rule", name).withColumn("_verdict", F.coalesce(verdict, method))
            .withColumn("_odds", F.col("_block")).drop("_block", "_grams", "_features", "_raw", "_label"))
