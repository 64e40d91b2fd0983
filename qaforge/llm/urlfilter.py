"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path.

Everything runs as DataFrame operations inside the JVM: string functions cut the address, a rule is a condition per entry, n-grams
are slices of the strings, and the n-grams are hashed and weighted by the DataFrame machine-learning stages.

The model learns from a small labelled table (url, label: 1 to block). `labelled_urls` builds one from the word lists below.

Defined results: a null url or one without `://` has an empty host and path and no rule, and is judged by the model (which
then has no n-grams and falls back on its constant); repeated urls are judged alike; an empty table gives an empty result; input columns named
like an output column are replaced. A labelled table with one class only gives that class to every url; an empty one is an error.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from qaforge.functions.common import let
from qaforge.llm.common import without

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
TASK_URLS = 100_000  # labelled urls of one task

# Words that stand in addresses one wants to keep out, and ordinary ones.
BLOCK_WORDS = (
    "ads adult bets betting bonus cams casino cheap clickbait coupon crack dating escort fake farm free gamble gambling hack jackpot keygen loans "
    "lottery malware payday phish pills pharma poker popup porn profit promo replica rich scam sex slots spam torrent track tracker viagra warez win xxx"
)
PLAIN_WORDS = (
    "about archive art atlas bank book bridge city climate college community council culture data design docs earth energy field finance food "
    "forum garden guide harbor health history home house island journal kids lab language law learn library local map market math media meadow mobile "
    "mountain museum music nature news ocean open paper park people photo physics plant press project public radio recipe research river road school "
    "science shop sport state stone story street studio study team theatre thing thought town train travel tree union university valley video village "
    "water weather web wiki wind winter world writer another brother evening father listening morning mother motion nation northern option other "
    "painting reading running setting shore singing southern station there these those together version within "
    "account address author blog business camera category comment company contact daily download downloads editor event feed files folder gallery "
    "german group headset help home-page image images index item jobs leads login member news-letter page pages post posts price product profile "
    "promise question report review roads search section service sextant shopping software subject support tag thread topic traction tutorial "
    "upload user view welcome window windows work answer before black bread change common course develop dinner engine family friend general "
    "green ground horse kitchen leather light manual master minute number order origin physical quick reader release round sample "
    "simple source spark spring stack standard summer system table teacher thanks theory thousand through trade value voice winner wood year"
)
# Both kinds of words take the same places, so that only the words tell them apart. {v} is a second word of the same list, {s} a suffix.
PLACES = "{w}.{s} www.{w}.{s} {w}-{v}.{s} www.{v}{w}.{s} my{w}.{s} the-{w}.{s} {w}24.{s} {w}.example.{s} m.{v}-{w}.site.{s} shop.{w}.{v}.{s} {w}s.{s}"
PATHS = "/{w} /{w}/ /pub/9/{w}/index.html /{w}.html /{w}/{v} /{v}/{w}.php /{w}-{v} /{v}_{w}.htm /category/{v}-{w}-88/ /2019/07/{w}-{v}/ /my{w} /{v}{w}s/"
# Parts without a word of either list.
BARE_PLACES = "example.{s} www.example.{s} 192.0.2.17 site12.{s} m.host.{s} a1.b2.{s} localhost:8080 www.page.{s} x.{s} cdn3.server.{s}"
BARE_PATHS = "/ /index.html /4711 /12/34/ /a/b.php /2020/11/05/ /p/7 /v1/id/33.json /~u/ /item.aspx"
SUFFIXES = "com net org info io co eu us de fr es it nl pl se ch at ca edu co.uk com.au com.br co.jp"


def _words(text: str) -> Column:
    return F.explode(F.split(F.lit(text), " "))


def _pick(text: str, *key: str | Column) -> Column:
    """A word of the text by the hash of the key."""
    return F.get(F.split(F.lit(text), " "), F.pmod(F.xxhash64(*key), F.lit(max(len(text.split()), 1))).cast("int"))


def _filled(pattern: Column, word: Column, words: str, *key: str | Column) -> Column:
    marks = (("{w}", word), ("{v}", _pick(words, F.lit("v"), *key)), ("{s}", _pick(SUFFIXES, F.lit("s"), *key)))
    for mark, value in marks:
        pattern = F.replace(pattern, F.lit(mark), value)
    return pattern


def labelled_urls(spark: SparkSession, block: str = BLOCK_WORDS, plain: str = PLAIN_WORDS) -> DataFrame:
    """(url, label) made from the word lists: each word in each host shape and in each path shape.

    Each of these hosts comes with three paths, and each of these paths with three hosts: one with block words, one with plain words, one with
    none. An address is to be blocked if either part has block words.
    """
    one = spark.range(1)
    tables = []
    lists = [(words, label) for words, label in ((block, 1.0), (plain, 0.0)) if words]
    shapes = {"host": (PLACES, BARE_PLACES), "path": (PATHS, BARE_PATHS)}
    for part, rest in (("host", "path"), ("path", "host")):
        for words, label in lists:
            rows = one.select(_words(words).alias("w")).select("w", _words(shapes[part][0]).alias("pattern"))
            for k, (others, other_label) in enumerate([*lists, ("", 0.0)]):
                key = (F.lit(f"{rest}{k}"), "pattern", "w")
                with_word, bare = shapes[rest]
                other = _filled(_pick(with_word if others else bare, F.lit("shape"), *key), _pick(others, F.lit("w"), *key), others, *key)
                text = {part: _filled(F.col("pattern"), F.col("w"), words, "pattern", "w"), rest: other}
                tables.append(rows.select(F.concat(F.lit("https://"), text["host"], text["path"]).alias("url"), F.lit(max(label, other_label)).alias("label")))
    return reduce(DataFrame.unionByName, tables)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; path: from there up to `?`, `#` or the end."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls. A rule is `host/path`; it fits the host and its subdomains."""
    hits, verdicts = [F.lit(None).cast("string")], [F.lit(None).cast("string")]
    for verdict, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        at, _, below = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + below)
        hits.insert(-1, F.when(fits, rule))
        verdicts.insert(-1, F.when(fits, verdict))
    return F.coalesce(*hits), F.coalesce(*verdicts)


def _slices(text: Column, mark: str, sizes: Sequence[int]) -> Column:
    """Every run of `size` characters of the marked text, for each size; texts shorter than that have none.

    The text is cut into characters once, and each run is put together from its own: a url of any length costs its length.
    """

    def runs(chars: Column) -> Column:
        def cut(size: int) -> Column:
            last = F.size(chars) - size + 1
            each = F.transform(F.sequence(F.lit(0), F.greatest(last - 1, F.lit(0))), lambda i: F.concat(F.lit(mark), *[F.get(chars, i + j) for j in range(size)]))
            return F.when(last > 0, each).otherwise(F.array().cast("array<string>"))

        return F.concat(*[cut(size) for size in sizes])

    marked = F.concat(F.lit(mark), text, F.lit("$"))
    return F.when(F.length(text) > 0, let(F.split(marked, ""), runs)).otherwise(F.array().cast("array<string>"))


def grams(host: Column, path: Column, sizes: Sequence[int] = GRAMS) -> Column:
    """Character n-grams of host and path, marked by where they stand; digits of the path count as one digit."""
    return F.concat(_slices(host, "^", sizes), _slices(F.regexp_replace(path, "[0-9]+", "0"), "~", sizes))


def _with_grams(df: DataFrame, url: str) -> DataFrame:
    host, path = host_and_path(F.col(url))
    return df.withColumns({"__host": host, "__path": path}).withColumn("__grams", grams(F.col("__host"), F.col("__path")))


def train(labelled: DataFrame, buckets: int = BUCKETS, penalty: float = 0.0003) -> PipelineModel:
    """Fit on (url, label)."""
    # In order, and dealt by url, the sums are the same in every run. A small table takes one task per pass over it.
    given = labelled.filter("label is not null").select("url", F.col("label").cast("double").alias("label"))
    given = given.repartitionByRange(max(1, -(-given.count() // TASK_URLS)), "url", "label").sortWithinPartitions("url", "label")
    rows = _with_grams(given, "url").select("__grams", "label")
    stages = [
        HashingTF(inputCol="__grams", outputCol="__hashed", numFeatures=buckets, binary=True),
        LogisticRegression(featuresCol="__hashed", labelCol="label", probabilityCol="__probability", rawPredictionCol="__raw", predictionCol="__class", regParam=penalty, standardization=False, maxIter=60),
    ]
    return Pipeline(stages=stages).fit(rows)


def judge_urls(df: DataFrame, model: PipelineModel, rules: Sequence[tuple[str, str]] = (), url: str = "url", threshold: float = 0.5) -> DataFrame:
    """Add `host`, `path`, `rule`, `score` (probability that the address is to be blocked) and `verdict` (allow or block)."""
    rows = without(df, ["host", "path", "rule", "score", "verdict"])
    scored = model.transform(_with_grams(rows, url))
    rule, verdict = rule_for(F.col("__host"), F.col("__path"), rules)
    score = F.get(vector_to_array("__probability"), F.lit(1))
    return scored.select(
        *[F.col(f"`{c}`") for c in rows.columns], F.col("__host").alias("host"), F.col("__path").alias("path"), rule.alias("rule"), score.alias("score"),
        F.coalesce(verdict, F.when(score >= threshold, "block").otherwise("allow")).alias("verdict"),
    )
