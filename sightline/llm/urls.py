"""URL filters: domain rules, and logistic regression on hashed character n-grams.

Pages are judged with built-in expressions only. The model is fitted from the
small table of labelled URLs below, whose n-grams go through the same
expressions as the pages'; its weights are an array of DIMENSIONS numbers.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.frames import kept, table

DIMENSIONS = 1 << 14
GRAMS = (3, 4)
MADE = ("host", "path", "rule", "verdict", "score")
#: Fixed values: (host, path, blocks).
RULES = (("com", "/en/", True), ("example.com", "/en/7", False), ("net", "/de/", False), ("example.net", "/de/8", True), ("org", "/es/", True))
#: The labelled table: words and invented names that stand in hosts and paths of unwanted and of wanted URLs, in English and its neighbours.
UNWANTED = (
    "casino", "poker", "slots", "jackpot", "roulette", "betting", "bets", "bookie", "lottery", "sweepstakes", "prize", "winner", "bonus", "pills", "viagra", "cialis", "pharma-rx", "cheap-meds", "weight-loss", "diet-pill", "adult", "porn", "xxx", "sexcam", "escort",
    "hookup", "singles", "nude", "payday", "quick-loan", "cash-advance", "debt-relief", "forex", "crypto-profit", "doubler", "get-rich", "make-money", "work-from-home", "replica", "fake-watch", "knockoff", "warez", "keygen", "crack", "serial-key", "torrent", "free-download",
    "spam", "spammer", "link-farm", "backlinks", "seo-boost", "clickbait", "adserver", "ad-track", "tracker", "popunder", "banner-ads", "affiliate", "coupon-code", "cheap-shop", "discount-bags", "miracle-cure", "phish", "malware", "free-iphone",
)
WANTED = (
    "library", "museum", "gallery", "archive", "encyclopedia", "dictionary", "university", "college", "school", "faculty", "institute", "academy", "research", "journal", "physics", "chemistry", "biology", "astronomy", "mathematics", "geology", "history", "philosophy", "language", "poetry",
    "theatre", "orchestra", "music", "cinema", "painting", "garden", "kitchen", "recipes", "bakery", "farm", "forest", "rivers", "mountain", "hiking", "cycling", "sailing", "football", "chess", "weather", "climate", "news", "gazette", "herald", "tribune", "city-council", "parliament", "ministry",
    "court", "hospital", "clinic", "nursing", "open-source", "compiler", "database", "kernel", "robotics", "engineer", "railway", "airport", "travel", "village", "parish", "wetter", "zeitung", "schule", "bibliothek", "musique", "cuisine", "jardin", "ecole", "biblioteca", "cocina", "escuela", "noticias",
)
#: Hosts and paths of the table: a word beside neutral ones.
FORMS = ("https://{}.example.com/en/{}", "http://www.{}.example.net/fr/{}.html", "https://m.{}-online.example.org/de/{}/", "http://blog.my-{}.example.net/es/{}", "https://the{}.example.com/{}", "https://forum.site.example.org/{}/{}")
EPOCHS = 12
RATE = 0.5
DECAY = 1e-4


def host_of(url: Column) -> Column:
    """Behind the first :// up to / ? # or the end, A-Z lower-cased; empty for null or without ://."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def grams(text: Column, dimensions: int) -> Column:
    """The hashed character n-grams of a text between two marks, as an array of buckets."""
    marked = F.concat(F.lit("^"), text, F.lit("$"))

    def of_size(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(marked) - (n - 1)))
        return F.transform(starts, lambda i: F.pmod(F.xxhash64(F.lit(n), F.substring(marked, i, F.lit(n))), F.lit(dimensions)).cast("int"))

    return F.concat(*[of_size(n) for n in GRAMS])


def features(host: Column, path: Column, dimensions: int) -> Column:
    """Buckets of the n-grams of the whole host and of the path, in which every run of digits became one 0."""
    return F.array_distinct(F.concat(grams(host, dimensions), grams(F.concat(F.lit("/"), F.regexp_replace(path, "[0-9]+", "0")), dimensions)))


def invented_names(n: int = 120, seed: int = 5) -> list[str]:
    """Meaningless names: most hosts have one, so a name alone is no reason to block."""
    rnd = random.Random(seed)
    return ["".join(rnd.choice("bcdfghklmnprstvwz") + rnd.choice(("a", "e", "i", "o", "u", "an", "er", "ion", "ou")) for _ in range(rnd.randint(2, 3))) for _ in range(n)]


def table_of(words: Sequence[str], label: int) -> list[tuple[str, int]]:
    """The URLs of each word in every form, with their label."""
    return [(f.format(w, 100 + 7 * i), label) for i, w in enumerate(words) for f in FORMS]


def train(spark: SparkSession, dimensions: int = DIMENSIONS, labelled: Sequence[tuple[str, int]] | None = None) -> tuple[list[float], float]:
    """Weights and bias, by gradient descent over the labelled table in its order."""
    if labelled is None:
        labelled = table_of(UNWANTED, 1) + table_of((*WANTED, *invented_names()), 0) + [("", 0)] * len(FORMS)  # nothing is no reason to block, either
    t = spark.createDataFrame([(i, u, y) for i, (u, y) in enumerate(labelled)], "i int, url string, y int")
    rows = sorted((r.i, r.f, r.y) for r in t.select("i", features(host_of(F.col("url")), path_of(F.col("url")), dimensions).alias("f"), "y").collect())
    w, bias, seen = [0.0] * dimensions, 0.0, [1e-8] * dimensions
    for _ in range(EPOCHS):
        for _i, f, y in rows:
            z = bias + sum(w[k] for k in f) / math.sqrt(len(f))
            g = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y
            step = g / math.sqrt(len(f))
            for k in f:
                d = step + DECAY * w[k]
                seen[k] += d * d
                w[k] -= RATE * d / math.sqrt(seen[k])
            bias -= 0.05 * g
    return w, bias


def judge(pages: DataFrame, *, labelled: Sequence[tuple[str, int]] | None = None, url_col: str = "url", keep: Sequence[str] = ("page_id",), rules: Sequence[tuple[str, str, bool]] = RULES, dimensions: int = DIMENSIONS, threshold: float = 0.5) -> DataFrame:
    """One row per row of pages: the columns of keep, host, path, rule, verdict, score.

    The longest fitting rule (host and path together) gives the verdict; where none
    fits, block if the model's score is at least the threshold, else allow. A null
    url, or one without ://, has an empty host and path, fits no rule and gets the
    model's verdict of these (allow). Repeated rows each come out; an empty table gives no rows; a kept column
    with an output's name comes out as in_<name>.
    """
    weights, bias = train(pages.sparkSession, dimensions, labelled)
    held = F.from_json(F.lit(json.dumps(weights)), "array<double>")
    carried = pages.select(*kept(pages, keep, MADE)).columns
    own = [f"k{i}" for i in range(len(carried))]
    parts = pages.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keep, own, strict=True)], host_of(F.col(f"`{url_col}`")).alias("host"), path_of(F.col(f"`{url_col}`")).alias("path"))
    found = F.lit(None).cast("string")
    blocks = F.lit(None).cast("boolean")
    for h, p, b in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((F.col("host") == h) | F.endswith(F.col("host"), F.lit("." + h))) & F.startswith(F.col("path"), F.lit(p))
        found, blocks = F.when(fits, F.lit(h + p)).otherwise(found), F.when(fits, F.lit(b)).otherwise(blocks)
    f = F.col("__f")
    z = F.aggregate(f, F.lit(0.0), lambda s, k: s + F.get(held, k)) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double")) + F.lit(bias)
    score = 1 / (1 + F.exp(-z))
    scored = parts.withColumn("__f", features(F.col("host"), F.col("path"), dimensions)).withColumn("score", score).withColumn("rule", found).withColumn("__b", blocks)
    verdict = F.when(F.coalesce("__b", F.col("score") >= threshold), F.lit("block")).otherwise(F.lit("allow"))
    return scored.withColumn("verdict", verdict).drop("__f", "__b").select(*own, *MADE).toDF(*carried, *MADE)


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
