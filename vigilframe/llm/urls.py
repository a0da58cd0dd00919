"""URL filters: rules on host and path, and a logistic regression on hashed character n-grams."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, functions as F

from vigilframe.llm.common import let, lower_ascii, query, stage, table

FEATURES = 1 << 15
SIZES = (3, 4)
#: Labelled URLs that the classifier is fitted on at most: those with the smallest hashes.
TRAIN_ROWS = 20_000
#: (host, path, verdict)
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Words whose presence in a host marks a URL of the labelled sample as one to block.
BLOCK_WORDS = [
    "ads", "adult", "adware", "bet", "bets", "betting", "casino", "clickbait", "gambling", "jackpot", "malware",
    "phishing", "pills", "poker", "porn", "scam", "slots", "spam", "track", "tracker", "viagra", "warez", "xxx",
]
#: Labelled by hand, so that both labels are known on the smallest tables too: (url, 1 to block).
EXAMPLES = [
    *[(f"https://{h}.example.com/en/{k}", 1) for k, h in enumerate([
        "ads-track", "track-ads", "adult-x", "adult-films", "free-bets", "sure-bets", "casino-win", "casino-royal",
        "cheap-pills", "diet-pills", "spam-farm", "spam-mail", "poker-room", "jackpot-slots", "xxx-porn", "phishing-kit",
    ])],
    *[(f"https://{h}.example.org/de/{k}", 0) for k, h in enumerate([
        "blog", "www", "news", "m", "docs", "library", "museum", "research", "history-club", "open-data", "town-hall",
        "weather", "recipes", "garden-notes", "school", "science",
    ])],
]


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), r"\A([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"\A[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """A host and all its parent domains."""
    labels = lambda h: F.split(h, r"\.")
    return let(
        labels(host),
        lambda ls: F.transform(F.sequence(F.lit(1), F.size(ls)), lambda i: F.array_join(F.slice(ls, i, F.size(ls)), ".")),
    )


def rule_table(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def with_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Add ``rule`` and ``rule_verdict`` to rows with ``host`` and ``path``: of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.  Rules that fit a
    host are gathered once per distinct host, so a host with very many pages costs no more than another.
    """
    held = rules.select(
        F.col("host").alias("suffix"),
        F.struct(
            (F.length("host") + F.length("path")).alias("size"), F.concat("host", "path").alias("rule"), "path", "verdict"
        ).alias("r"),
    )
    fits = (
        urls.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("suffix"))
        .join(held, "suffix").groupBy(F.col("host").alias("_host")).agg(F.sort_array(F.collect_list("r"), asc=False).alias("_rules"))
    )
    best = F.get(F.filter("_rules", lambda r: F.startswith(F.col("path"), r.path)), F.lit(0))
    return (
        urls.join(fits, F.col("host") == F.col("_host"), "left")
        .withColumn("_best", best)
        .withColumns({"rule": F.col("_best.rule"), "rule_verdict": F.col("_best.verdict")})
        .drop("_host", "_rules", "_best")
    )


def url_ngrams(host: Column, path: Column) -> Column:
    """Character n-grams of host and path, each marked with where it comes from."""

    def grams(mark: str, text: Column) -> list[Column]:
        padded = F.concat(F.lit("^"), text, F.lit("$"))
        return [
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1))),
                lambda i: F.concat(F.lit(mark), F.substring(padded, i, n)),
            )
            for n in SIZES
        ]

    return F.concat(*grams("h:", host), *grams("p:", path))


def _features(rows: DataFrame, n_features: int) -> DataFrame:
    grams = rows.withColumn("_grams", url_ngrams(F.col("host"), F.col("path")))
    return HashingTF(numFeatures=n_features, binary=True, inputCol="_grams", outputCol="_features").transform(grams).drop("_grams")


def fit_urls(labelled: DataFrame, max_rows: int = TRAIN_ROWS, n_features: int = FEATURES):
    """A model for (host, path, label); label is 1 for block and 0 for allow.

    Fitted on the ``max_rows`` labelled URLs with the smallest hashes.  Returns the label itself where all
    rows have the same, and 0 where there are none.
    """
    rows = labelled.select("host", "path", F.col("label").cast("double").alias("label")).where(F.col("label").isNotNull())
    rows = rows.distinct().orderBy(F.xxhash64("host", "path"), "label").limit(max_rows)
    rows = stage(rows, "url-labels")
    n, blocked = rows.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or blocked in (0, n):
        return 1.0 if blocked else 0.0
    # Both labels weigh the same in all.
    rows = rows.withColumn("_weight", F.when(F.col("label") > 0, n / (2 * blocked)).otherwise(n / (2 * (n - blocked))))
    learner = LogisticRegression(
        featuresCol="_features", labelCol="label", weightCol="_weight", regParam=1e-3, maxIter=30,
        probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_block",
    )
    return learner.fit(_features(rows, n_features))


def predict_urls(urls: DataFrame, model, n_features: int = FEATURES) -> DataFrame:
    """Add ``predicted`` (allow or block) to rows with ``host`` and ``path``."""
    if isinstance(model, float):
        return urls.withColumn("predicted", F.lit("block" if model else "allow"))
    scored = model.transform(_features(urls, n_features))
    return scored.withColumn("predicted", F.when(F.col("_block") > 0, "block").otherwise("allow")).drop("_features", "_raw", "_p", "_block")


def labelled_sample(urls: DataFrame, max_rows: int = TRAIN_ROWS, block_words=BLOCK_WORDS, examples=EXAMPLES) -> DataFrame:
    """A small labelled table (url, label): the ``max_rows`` urls with the smallest hashes, and ``examples``.

    A sampled url is one to block (1) if its host has one of ``block_words`` between dots and hyphens.
    """
    sample = urls.select("url").where(F.col("url").isNotNull()).distinct().orderBy(F.xxhash64("url"), "url").limit(max_rows)
    found = F.arrays_overlap(F.split(url_host(F.col("url")), "[.-]"), F.array(*[F.lit(w) for w in block_words]))
    return sample.select("url", found.cast("int").alias("label")).unionByName(
        urls.sparkSession.createDataFrame(examples, "url string, label int")
    )


def filter_urls(urls: DataFrame, rules: DataFrame, labelled: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` and ``verdict`` to every row of ``urls`` (a column ``url``).

    The verdict is that of the longest rule that fits, else the classifier's, which is fitted on
    ``labelled`` (url, label: 1 for block).  Null urls and urls without ``://``: empty host and path, judged
    by the classifier.  A url of any length is one row.  Rules of equal length cannot both fit, so there are no
    ties.  An empty table gives no rows.  Repeated rows are judged alike; without labels everything else is allowed.
    Columns of ``urls`` with the name of an added one are replaced.
    """
    added = ("host", "path", "rule", "verdict", "rule_verdict", "predicted")
    keep = [c for c in urls.columns if c.lower() not in added]
    parsed = urls.select(*keep, url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    known = labelled.select(url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"), "label")
    judged = predict_urls(with_rules(parsed, rules), fit_urls(known, max_rows))
    return judged.select(*keep, "host", "path", "rule", F.coalesce("rule_verdict", "predicted").alias("verdict"))


@query("op7_url_filter")
def op7_url_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, rule_table(spark), labelled_sample(pages)).drop("url")
