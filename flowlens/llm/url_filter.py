"""URL filter: rules first, then naive Bayes over the words of host and path.

Host names are split at dots, hyphens and digits; what remains may be several words run together
and is split by a unigram Viterbi pass: the most probable sequence of words, with probabilities
from the counts of words in the pages' own text (all pages; seed words count as seen). Every
distinct piece is split once: its substrings join the word counts, so no task needs the
vocabulary. Multinomial naive Bayes then scores host words and path tokens. Its examples are all
urls: those that hold a seed word are examples to block, the others to allow; each url weighs as
often as it occurs. Rules need no model: the longest rule that fits decides.

Defined cases: a null url, or one without ``://``, has an empty host and path, no tokens and thus the
verdict of the class priors; repeated pages and null ids are judged row by row; a page without
html adds no words; without pages the result is empty; other columns are not read.
"""
from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: (verdict, rule): host and path; a rule fits its host and all subdomains.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Words that mark an example to block.
SEEDS = ("ads", "adserver", "adult", "banner", "bet", "bets", "betting", "casino", "cheap", "crack", "escort", "gamble", "gambling",
         "hack", "keygen", "loans", "lottery", "payday", "pharmacy", "pill", "pills", "poker", "porn", "replica", "sex", "spam",
         "torrent", "tracker", "tracking", "viagra", "warez", "xxx")
SEED_COUNT = 1000      # occurrences that a seed word counts as
MOST_LETTERS = 20      # of a word in a host name
SMOOTHING = 1.0
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the longest is asked first
        name, slash, tail = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_words(pages: DataFrame, html_col: str) -> DataFrame:
    """word, count over the text of all pages (tags, scripts and styles dropped) and the seeds."""
    text = F.regexp_replace(F.regexp_replace(F.col(html_col), r"(?is)<(script|style)\b.*?</\1>", " "), r"<[^>]*>|&[a-z]+;", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    words = words.where((F.length("word") >= 1) & (F.length("word") <= MOST_LETTERS)).groupBy("word").agg(F.count("*").alias("count"))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in SEEDS], "word string, count long")
    return words.union(seeds).groupBy("word").agg(F.sum("count").alias("count"))


def segment(piece: str, words: dict[str, int], total: int) -> list[str]:
    """The most probable split of a piece into words; unknown ones get rarer with length."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    for end in range(1, len(piece) + 1):
        options = []
        for begin in range(max(0, end - MOST_LETTERS), end):
            word = piece[begin:end]
            count = words.get(word, 0)
            p = math.log(count / total) if count else math.log(10 / total) - (end - begin) * math.log(10)
            options.append((best[begin][0] + p, begin))
        best.append(max(options))
    out, at = [], len(piece)
    while at:
        out.append(piece[best[at][1]:at])
        at = best[at][1]
    return out[::-1]


def _split(total):
    def run(batches):
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            known = batch.column(1).to_pylist()
            parts = [segment(p, {k["word"]: k["count"] for k in ks or []}, total) for p, ks in zip(pieces, known)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.list_(pa.string()))], names=["piece", "parts"])
    return run


def split_pieces(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """pieces (piece, distinct) -> piece, parts."""
    total = words.agg(F.sum("count").alias("t")).first()["t"] or 1
    at = F.sequence(F.lit(1), F.length("piece"))
    spans = F.flatten(F.transform(at, lambda b: F.transform(
        F.sequence(F.lit(1), F.least(F.lit(MOST_LETTERS), F.length("piece") - b + 1)), lambda n: F.substring(F.col("piece"), b, n))))
    subs = pieces.select("piece", F.explode(F.array_distinct(spans)).alias("word"))
    known = subs.join(words, "word").groupBy("piece").agg(F.collect_list(F.struct("word", "count")).alias("known"))
    return pieces.join(known, "piece", "left").select("piece", "known").mapInArrow(_split(int(total)), "piece string, parts array<string>")


def verdicts(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and block_score (log odds of block) of every page."""
    urls = written(pages.groupBy(F.col(url_col).alias("url")).agg(F.count("*").alias("pages"))
                   .withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))), "urls")
    hosts = urls.select("host").distinct()
    host_pieces = written(hosts.select("host", F.posexplode(F.split("host", r"[^\p{L}]+")).alias("place", "piece")).where("piece <> ''"), "host-pieces")
    words = written(page_words(pages, html_col), "page-words")
    parts = written(split_pieces(host_pieces.select("piece").distinct(), words), "piece-parts")
    host_tokens = written(host_pieces.join(parts, "piece").groupBy("host")
                          .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "parts"))), lambda x: x["parts"])).alias("host_tokens")), "host-tokens")
    in_path = F.filter(F.split(F.lower("path"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    path_tokens = F.transform(in_path, lambda t: F.concat(F.lit("/"), F.when(t.rlike(r"^\p{N}+$"), F.lit("0")).otherwise(t)))
    tokens = written(urls.join(host_tokens, "host", "left")
                     .select("url", "pages", F.concat(F.coalesce("host_tokens", F.array().cast("array<string>")), path_tokens).alias("tokens"))
                     .withColumn("bad", F.exists("tokens", lambda t: F.regexp_replace(t, "^/", "").isin(*SEEDS))), "url-tokens")

    single = tokens.select("url", "pages", "bad", F.explode("tokens").alias("token"))
    counts = written(single.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("b"),
                                                 F.sum(F.when(~F.col("bad"), F.col("pages")).otherwise(0)).alias("a")), "token-counts")
    t = counts.agg(F.count("*").alias("v"), F.sum("b").alias("b"), F.sum("a").alias("a")).first()
    d = tokens.agg(F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("b"), F.sum(F.when(~F.col("bad"), F.col("pages")).otherwise(0)).alias("a")).first()
    v = max(t["v"], 1)
    n_b, n_a = (t["b"] or 0) + SMOOTHING * v, (t["a"] or 0) + SMOOTHING * v
    prior = math.log(((d["b"] or 0) + SMOOTHING) / ((d["a"] or 0) + SMOOTHING))
    weights = written(counts.select("token", (F.log((F.col("b") + SMOOTHING) / F.lit(n_b)) - F.log((F.col("a") + SMOOTHING) / F.lit(n_a))).alias("w")), "token-weights")
    scores = written(single.select("url", "token").join(weights, "token").groupBy("url").agg(F.sum("w").alias("w")), "url-scores")

    rule = rule_of(F.col("host"), F.col("path"), rules)
    judged = written(urls.join(scores, urls["url"].eqNullSafe(scores["url"]), "left").drop(scores["url"])
                     .select("url", "host", "path", rule.alias("r"), (F.coalesce("w", F.lit(0.0)) + F.lit(prior)).alias("block_score"))
                     .select("url", "host", "path", F.col("r.rule").alias("rule"), "block_score",
                             F.coalesce(F.col("r.verdict"), F.when(F.col("block_score") > 0, "block").otherwise("allow")).alias("verdict")), "url-verdicts")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_url"))
    return rows.join(judged, F.col("_url").eqNullSafe(F.col("url"))).select("page_id", "host", "path", "rule", "verdict", "block_score")
