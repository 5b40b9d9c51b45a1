"""URL filter: host rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from a table of labelled urls. The registered query has no labels but the verdicts of its rules; there the trees go by
lexical features and file endings only, not by the suffixes that the rules name.

Everything is DataFrame and SQL functions; the trees are Spark ML's. Only the url column is read.

* Null url, or one without ``://``: host and path are empty, no rule fits, the trees decide on
  the features of an empty url. Very long urls are taken whole.
* With labels of one class only, or none, there is nothing to learn: the verdict is ``allow``.
* Repeated rows are judged alike. Input columns are kept unless an output has their name.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuneframe.llm.registry import query, table
from tuneframe.llm.text import ascii_lower
from tuneframe.session import written

# Fixed values: (host, path, verdict).
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# Distinct labelled urls of each class that the trees learn from, in expectation: a threshold on a hash of the url.
SAMPLE = 20_000
TREES, DEPTH, STEP = 20, 4, 0.3
FOLDS = 5
_OUT = ("host", "path", "rule", "verdict", "block_probability")


def host_of(url) -> Column:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return ascii_lower(F.regexp_extract(F.coalesce(after, F.lit("")), "^[^/?#]*", 0))


def path_of(url) -> Column:
    at = F.locate("://", url)
    after = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.regexp_extract(F.coalesce(after, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_of(host, path, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, else null. Rules are a parameter, a row each."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, start, verdict in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(start))
        found = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _share(text, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text) -> Column:
    """Bits per character."""
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    counts = F.transform(F.array_distinct(F.split(text, "")), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.aggregate(F.filter(counts, lambda n: n > 0), F.lit(0.0), lambda a, n: a - n / size * F.log2(n / size))


def lexical_features(url, host, path) -> dict[str, Column]:
    url = F.coalesce(url, F.lit(""))
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    labels = F.split(host, r"\.")
    return {
        "f_length": F.length(url), "f_host_length": F.length(host), "f_path_length": F.length(path),
        "f_depth": F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))),
        "f_labels": F.size(labels), "f_digits": _share(url, "[^0-9]"), "f_host_digits": _share(host, "[^0-9]"),
        "f_marks": _share(url, "[A-Za-z0-9]"), "f_hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))),
        "f_entropy": _entropy(url), "f_host_entropy": _entropy(host),
        "f_parameters": F.when(asked == "", 0).otherwise(F.size(F.split(asked, "&"))),
        "f_parameter_length": F.length(asked), "f_fragment": F.locate("#", url).cast("boolean").cast("int"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("int"),
    }


def _suffixes(host, path) -> Column:
    """Suffixes whose share of blocked urls is a feature: last label, last two, the same with the
    first path segment, and the ending of the path."""
    last = F.substring_index(host, ".", -1)
    domain = F.substring_index(host, ".", -2)
    segment = F.regexp_extract(path, "^/([^/]*)/", 1)
    ending = F.regexp_extract(path, r"\.[A-Za-z0-9]+$", 0)
    return F.array(*(F.concat(F.lit(f"{i}:"), x) for i, x in enumerate((last, domain, F.concat(last, F.lit("/"), segment), F.concat(domain, F.lit("/"), segment), ending))))


LAST, DOMAIN, LAST_SEGMENT, DOMAIN_SEGMENT, ENDING = SUFFIXES = range(5)
# What host rules with a path say again: trees that learn from such rules' verdicts would learn the rules and nothing else.
RULE_SUFFIXES = (LAST, DOMAIN, LAST_SEGMENT, DOMAIN_SEGMENT)


def _with_features(pages: DataFrame) -> DataFrame:
    host, path = F.col("_u_host"), F.col("_u_path")
    pages = pages.withColumns({"_u_host": host_of(F.col("_u_url")), "_u_path": path_of(F.col("_u_url"))})
    return pages.withColumns({**lexical_features(F.col("_u_url"), host, path), "_u_suffixes": _suffixes(host, path)})


def _odds(blocked, seen) -> Column:
    return F.log((blocked + 0.5) / (seen - blocked + 0.5))


class UrlFilter:
    """Trees learned from labelled urls: ``fit`` once, then ``judge`` any table with a url column."""

    def __init__(self, spark, model, suffixes: DataFrame | None, kinds: tuple[int, ...]):
        self.spark, self.model, self.suffixes, self.kinds = spark, model, suffixes, kinds

    @classmethod
    def fit(cls, labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH, seed: int = 7, leave_out: tuple[int, ...] = ()) -> UrlFilter:
        """``labelled``: url, label (1 block, 0 allow); null labels are skipped. Suffixes of the kinds in ``leave_out`` are no features."""
        kinds = tuple(i for i in SUFFIXES if i not in leave_out)
        spark = labelled.sparkSession
        urls = labelled.filter(F.col("label").isNotNull()).groupBy(F.coalesce(F.col("url"), F.lit("")).alias("_u_url"))
        urls = written(urls.agg(F.max("label").cast("int").alias("label")), "url-labels")
        counts = {r["label"]: r["n"] for r in urls.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        if not (counts.get(0) and counts.get(1)):
            return cls(spark, None, None, kinds)
        # Two rows of counts; the threshold keeps about ``sample`` urls of each class at any size.
        chance = F.when(F.col("label") == 1, min(1.0, sample / counts[1])).otherwise(min(1.0, sample / counts[0]))
        unit = F.shiftrightunsigned(F.xxhash64("_u_url", F.lit(seed)), 11) / F.lit(float(2**53))
        kept = _with_features(urls.filter(unit < chance)).withColumn("_u_fold", F.pmod(F.xxhash64(F.lit(seed), "_u_url"), F.lit(FOLDS)))
        kept = written(kept.coalesce(8), "url-sample")
        one = kept.select("_u_fold", "label", F.explode("_u_suffixes").alias("suffix"))
        by_fold = one.groupBy("suffix", "_u_fold").agg(F.sum("label").alias("b"), F.count(F.lit(1)).alias("n"))
        total = by_fold.groupBy("suffix").agg(F.sum("b").alias("blocked"), F.sum("n").alias("seen"))
        total = written(total, "url-suffixes")
        # A url's own fold does not count in its suffix features.
        others = by_fold.join(total, "suffix").select("suffix", "_u_fold", _odds(F.col("blocked") - F.col("b"), F.col("seen") - F.col("n")).alias("odds"))
        fitted = cls(spark, None, total.select("suffix", _odds(F.col("blocked"), F.col("seen")).alias("odds")), kinds)
        rows = fitted._add_suffixes(kept, written(others, "url-folds"), ["suffix", "_u_fold"])
        names = [c for c in rows.columns if c.startswith("f_")]
        vector = VectorAssembler(inputCols=names, outputCol="_u_features", handleInvalid="keep")
        boosted = GBTClassifier(labelCol="label", featuresCol="_u_features", predictionCol="_u_prediction", maxIter=trees, maxDepth=depth, stepSize=STEP, seed=seed)
        boosted = boosted.setProbabilityCol("_u_probability").setRawPredictionCol("_u_raw")
        fitted.model = Pipeline(stages=[vector, boosted]).fit(written(rows, "url-train"))
        return fitted

    def _add_suffixes(self, rows: DataFrame, odds: DataFrame, keys: list[str]) -> DataFrame:
        """Suffix features by one join per kind; the table has at most 5 * FOLDS rows per sampled url, so it may be broadcast."""
        for i in self.kinds:
            side = odds.withColumnsRenamed({"suffix": "_u_s", "odds": f"f_suffix_{i}"})
            side = F.broadcast(side.withColumnsRenamed({"_u_fold": "_u_f"}) if "_u_fold" in keys else side)
            on = F.get("_u_suffixes", F.lit(i)) == F.col("_u_s")
            if "_u_fold" in keys:
                on = on & (F.col("_u_fold") == F.col("_u_f"))
            rows = rows.join(side, on, "left").drop("_u_s", "_u_f").withColumn(f"f_suffix_{i}", F.coalesce(f"f_suffix_{i}", F.lit(0.0)))
        return rows

    def judge(self, pages: DataFrame, rules=RULES) -> DataFrame:
        """Input columns, host, path, rule, verdict (allow or block) and block_probability."""
        keep = [c for c in pages.columns if c not in _OUT]
        rows = pages.select(*keep, F.col("url").alias("_u_url"))
        if self.model is None:
            rows = rows.withColumns({"_u_host": host_of(F.col("_u_url")), "_u_path": path_of(F.col("_u_url")), "_u_p": F.lit(0.0)})
        else:
            rows = self._add_suffixes(_with_features(rows), self.suffixes, ["suffix"])
            rows = self.model.transform(rows).withColumn("_u_p", F.get(vector_to_array("_u_probability"), F.lit(1)))
        rule = rule_of(F.col("_u_host"), F.col("_u_path"), rules)
        learned = F.when(F.col("_u_p") > 0.5, "block").otherwise("allow")
        return rows.withColumn("_u_rule", rule).select(
            *keep, F.col("_u_host").alias("host"), F.col("_u_path").alias("path"), F.col("_u_rule.rule").alias("rule"),
            F.coalesce(F.col("_u_rule.verdict"), learned).alias("verdict"), F.col("_u_p").alias("block_probability"),
        )


def rule_labels(pages: DataFrame, rules=RULES) -> DataFrame:
    """(url, label) of the urls that a rule decides."""
    rule = rule_of(host_of(F.col("url")), path_of(F.col("url")), rules)
    return pages.select("url", (rule["verdict"] == "block").cast("int").alias("label"))


@query("op2_url_filter")
def op2(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", "url")
    return UrlFilter.fit(rule_labels(pages), leave_out=RULE_SUFFIXES).judge(pages).select("page_id", "host", "path", "rule", "verdict", "block_probability")
