"""URL filter: host and path rules, and gradient-boosted trees on lexical features.

The main path is made of DataFrame and MLlib operations only, all of which run in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache
from itertools import count

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = [
    "url_chars", "host_chars", "path_chars", "query_chars", "depth", "labels", "longest_label", "hyphens", "host_digits", "digit_ratio", "entropy",
    "parameters", "escapes", "other_signs", "suffix_rate", "suffix_weight",
]

#: Endings of hosts, and of how many blocked and allowed ones in a hundred each is the ending in made-up labels.
SUFFIX_SHARES = {
    "com": (20, 38), "net": (12, 12), "org": (4, 16), "edu": (1, 5), "uk": (3, 7), "de": (3, 6), "fr": (2, 4), "es": (2, 3), "io": (4, 4),
    "info": (17, 2), "biz": (16, 1), "top": (9, 1), "xyz": (7, 1),
}
#: Of how many blocked and allowed URLs in a hundred each sign is true in made-up labels.
SIGNS = {
    "long_name": (70, 22), "hyphens": (55, 20), "host_digits": (50, 15), "deep": (50, 24), "parameters": (60, 20), "token": (52, 16),
    "escapes": (28, 6), "more_names": (45, 25), "signs": (30, 10),
}


def _rest(url: str) -> Column:
    """What follows the first ``://``, or nothing."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", u)
    return F.when(at > 0, u.substr(at + 3, F.length(u))).otherwise("")


def host_of(url: str) -> Column:
    """Host in the column ``url``: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path_of(url: str) -> Column:
    """Path in the column ``url``: from the end of the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def lexical(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Add host, path, suffix and the lexical features of each URL; a null URL counts as empty."""
    u = F.coalesce(F.col(url_col), F.lit(""))
    host, path = F.col("host"), F.col("path")
    count = lambda text, pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    letters = F.split(F.lower(u), "")
    shares = F.transform(F.array_distinct(letters), lambda c: (F.length(F.lower(u)) - F.length(F.replace(F.lower(u), c, F.lit("")))) / F.length(u))
    entropy = F.when(F.length(u) > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))).otherwise(0.0)
    names = F.split(host, r"\.")
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return urls.withColumns({"host": host_of(url_col), "path": path_of(url_col)}).withColumns({
        "suffix": F.regexp_extract(host, r"([^.]*)(?::\d*)?$", 1),
        "url_chars": F.length(u), "host_chars": F.length(host), "path_chars": F.length(path), "query_chars": F.length(query),
        "depth": F.length(F.regexp_replace(path, "[^/]", "")), "labels": F.size(names),
        "longest_label": F.array_max(F.transform(names, F.length)), "hyphens": F.length(F.regexp_replace(host, "[^-_]", "")),
        "host_digits": count(host, "[0-9]"), "digit_ratio": count(u, "[0-9]") / F.greatest(F.length(u), F.lit(1)), "entropy": entropy,
        "parameters": F.when(query == "", 0).otherwise(1 + F.length(F.regexp_replace(query, "[^&;]", ""))),
        "escapes": F.length(F.regexp_replace(u, "[^%]", "")), "other_signs": count(path, "[~!$'()*+,;=@]"),
    })


def made_labels(spark: SparkSession, rows: int = 4000, noise: int = 2) -> DataFrame:
    """Labelled URLs (url, label) made by rule from syllables: the default training set.

    Both kinds are made in the same way, from the same syllables. What tells them apart are
    the shares of ``SIGNS`` and ``SUFFIX_SHARES``: each sign is there in many of one kind and some of the other, and
    independent of the others, so none decides alone. ``noise`` in a hundred labels are wrong.
    """
    salts = count()

    def draw(n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(next(salts))), F.lit(n)).cast("int")

    @cache
    def listed(options: tuple[str, ...]) -> Column:
        return F.array(*[F.lit(x) for x in options])

    def of(options: list[str]) -> Column:
        return F.element_at(listed(tuple(options)), draw(len(options)) + 1)

    def word(least: int, most: int) -> Column:
        """Between ``least`` and ``most`` syllables."""
        syllables = [c + v for c in "bcdfglmnprstvw" for v in ("a", "e", "i", "o", "u", "er", "in", "al")]
        made, n = [of(syllables) for _ in range(most)], draw(most - least + 1) + least
        return F.concat(*[x if k < least else F.when(n > k, x).otherwise("") for k, x in enumerate(made)])

    def number(digits: int) -> Column:
        return draw(10**digits).cast("string")

    bad = F.pmod("id", F.lit(2)) == 1
    sign = {name: draw(100) < F.when(bad, blocked).otherwise(allowed) for name, (blocked, allowed) in SIGNS.items()}
    endings = [F.array(*[F.lit(e) for e, shares in SUFFIX_SHARES.items() for _ in range(shares[k])]) for k in (0, 1)]
    suffix = F.element_at(F.when(bad, endings[0]).otherwise(endings[1]), draw(100) + 1)
    dash = F.when(sign["hyphens"], "-").otherwise("")
    name = F.concat(
        word(1, 3), dash, F.when(sign["long_name"], F.concat(word(3, 5), F.when(sign["hyphens"] & (draw(2) == 0), "-").otherwise(""), word(1, 3))).otherwise(word(1, 2)),
        F.when(sign["host_digits"], number(4)).otherwise(""),
    )
    front = F.when(draw(3) == 0, F.concat(of(["www", "m", "blog", "shop", "docs", "en"]), F.lit("."))).otherwise("")
    front = F.concat(front, F.when(sign["more_names"], F.concat(word(1, 3), F.lit("."))).otherwise(""))
    token = F.substring(F.lower(F.hex(F.xxhash64("id", F.lit(next(salts))))), 1, 12)
    step = lambda: F.concat(F.lit("/"), word(1, 6))
    path = F.concat(
        F.when(draw(5) > 0, step()).otherwise(""), F.when(sign["deep"], F.concat(step(), step(), F.when(draw(2) == 0, step()).otherwise(""))).otherwise(""),
        F.when(draw(4) == 0, F.concat(F.lit("/"), number(5))).otherwise(""), F.when(sign["escapes"], F.concat(F.lit("%20"), word(1, 2), F.lit("%2F"))).otherwise(""),
        F.when(sign["signs"], F.concat(of(["~", "=", "+", ",", ";", "!", "@"]), word(1, 2))).otherwise(""),
        F.when(sign["token"] & (draw(2) == 0), F.concat(F.lit("/"), token)).otherwise(""), of(["", "", "/", ".html", ".php", "/index.htm"]),
    )
    keys = lambda: of(["id", "q", "p", "ref", "page", "lang", "aff", "click", "sid", "src", "v", "utm_source"])
    pair = lambda: F.concat(keys(), F.lit("="), F.when(draw(2) == 0, number(4)).otherwise(word(1, 4)))
    more = F.concat(F.lit("?"), pair(), F.lit("&"), pair(), F.when(draw(2) == 0, F.concat(F.lit("&"), pair())).otherwise(""), F.when(sign["token"], F.concat(F.lit("&s="), token)).otherwise(""))
    query = F.when(sign["parameters"], more).when(draw(4) == 0, F.concat(F.lit("?"), pair())).when(draw(8) == 0, F.concat(F.lit("#"), word(1, 3))).otherwise("")
    url = F.concat(of(["http://", "https://", "https://"]), front, name, F.lit("."), suffix, path, query)
    return spark.range(rows).select(url.alias("url"), (bad != (draw(100) < noise)).cast("int").alias("label"))


class UrlModel:
    """Boosted trees and the suffix statistics that two of their features come from."""

    def __init__(self, trees: GBTClassificationModel | None, suffixes: DataFrame, constant: float):
        self.trees, self.suffixes, self.constant = trees, suffixes, constant

    def add_verdict(self, urls: DataFrame, out: str = "model_block") -> DataFrame:
        """Add the model's decision for rows that have the lexical features."""
        if self.trees is None:
            return urls.withColumn(out, F.lit(self.constant > 0.5))
        ready = _with_suffix(urls, self.suffixes)
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(ready)
        return self.trees.setFeaturesCol("_features").setPredictionCol("_p").setRawPredictionCol("").setProbabilityCol("").transform(vectors).withColumn(out, F.col("_p") == 1).drop("_p", "_features")


def _with_suffix(urls: DataFrame, suffixes: DataFrame) -> DataFrame:
    """Suffix statistics; the table has at most a row for each labelled URL, which bounds the broadcast."""
    return urls.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_rate": 0.5, "suffix_weight": 0.0})


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most_rows: int = 20_000, rounds: int = 20, depth: int = 4, seed: int = 1) -> UrlModel:
    """Fit on labelled URLs (label 1: block, 0: allow), at most ``most_rows`` of them by hash.

    Suffix statistics of a training row come from the other half of the rows, so that
    its own label is not among its features. Null URLs and labels teach nothing; with
    labels of one kind the model is constant, with none it allows.
    """
    rows = pick(labelled, url_col, label_col).select(F.col(url_col).alias("url"), F.col(label_col).cast("double").alias("label")).where("url is not null and label in (0, 1)")
    rows = lexical(rows.orderBy(F.xxhash64("url"), "url", "label").limit(most_rows)).withColumn("fold", F.pmod(F.xxhash64("url", F.lit(7)), F.lit(2)))
    rows = stored(rows, "labelled-urls")  # every tree reads them
    found = rows.agg(F.count("*").alias("n"), F.avg("label").alias("mean")).first()
    rate = ((F.sum("label") + 2 * F.lit(found["mean"] or 0.0)) / (F.count("*") + 2)).alias("suffix_rate")
    weight = (F.count("*") / F.lit(max(found["n"], 1))).alias("suffix_weight")
    suffixes = rows.groupBy("suffix").agg(rate, weight)
    if not found["n"] or found["mean"] in (0.0, 1.0):
        return UrlModel(None, suffixes, found["mean"] or 0.0)
    across = rows.groupBy("suffix", (1 - F.col("fold")).alias("fold")).agg(rate, weight)
    ready = rows.join(F.broadcast(across), ["suffix", "fold"], "left").fillna({"suffix_rate": 0.5, "suffix_weight": 0.0})
    ready = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(ready).select("features", "label").coalesce(1), "url-vectors")
    trees = GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed, checkpointInterval=-1).fit(ready)
    return UrlModel(trees, suffixes, found["mean"])


def best_rule(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, or null.

    A rule is a host and the start of a path, such as ``net/``. It fits the host and
    all its subdomains, if the path starts with the rule's.
    """
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def judge(pages: DataFrame, model: UrlModel, rules: Iterable[tuple[str, str]] = (), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the rule that decides, and the verdict on every URL, one row per input row.

    The longest fitting rule decides; where none fits, the boosted trees do. Host and path are
    empty for a null URL or one without ``://``, which are judged like any other. Null
    ids stay null, repeated rows stay repeated, an empty table gives an empty result,
    other columns are ignored.
    """
    rows = pick(pages, id_col, url_col).select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"))
    judged = model.add_verdict(lexical(rows)).withColumn("found", best_rule(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce("found.verdict", F.when(F.col("model_block"), "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "model_block")
