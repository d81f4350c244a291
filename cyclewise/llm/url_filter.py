"""URL filters: rules first, then words of host and path.

Rules name a host and a path prefix. A URL that no rule decides is judged by
its words: host names are written without spaces, so each is cut into words by
a Viterbi search over the word frequencies of the pages' own text, and a
multinomial naive Bayes model scores the words of host and path. The model is
learned from all pages: those with a seed word in the host, or with seed words
as a share of their text, are examples to block, the others examples to allow.
So a host without a seed is blocked for words it shares with blocked examples or
for the texts of its pages, and one with a seed can be allowed. Rules are policy
of single sites, not examples of content, and teach it nothing.
"""

from __future__ import annotations

import math
import string
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewise.llm.common import staged

#: longest part between the dots of a host name (fixed by the name system): no longer word is looked up
MAX_WORD = 63
#: words that mark an example to block; a setting
SEEDS = ("adult", "ads", "adserver", "bet", "bets", "betting", "casino", "escort", "gambling", "jackpot", "loan",
         "loans", "malware", "payday", "pharmacy", "phishing", "pills", "poker", "porn", "scam", "sex", "slots",
         "spam", "torrent", "track", "tracker", "viagra", "warez", "xxx")
#: a seed word counts as one word in so many when hosts are cut
SEED_SHARE = 10_000
#: share of seed words in a page's text from which it is an example to block
SEED_TEXT = 0.02
Rule = tuple[str, str, str]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ? or #, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_for(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Number of the longest rule that fits, or null. A rule fits its host and
    all subdomains, where the path starts with the rule's path."""
    out = F.lit(None).cast("int")
    for i, (_, h, p) in sorted(enumerate(rules), key=lambda x: len(x[1][1]) + len(x[1][2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.lit(i)).otherwise(out)
    return out


def text_words(html: Column) -> Column:
    """Letter words of the text outside tags, comments and scripts, lower-cased."""
    text = F.regexp_replace(F.lower(html), r"(?s)<(script|style)\b.*?</\1>|<!--.*?-->|<[^>]*>", " ")
    return F.regexp_extract_all(text, F.lit(r"([a-z]+)"), F.lit(1))


def word_counts(html: Column, pages: DataFrame) -> DataFrame:
    """(word, n): letter words of all pages' text."""
    return (pages.select(F.explode(text_words(html)).alias("word")).filter(F.length("word") <= MAX_WORD)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def seeded_text(html: Column, seeds: Sequence[str], share: float = SEED_TEXT) -> Column:
    """Whether seed words are at least ``share`` of the words of a text; false without words."""
    words = F.coalesce(text_words(html), F.array().cast("array<string>"))
    hits = F.size(F.filter(words, lambda w: w.isin(list(seeds)))) if seeds else F.lit(0)
    return (hits > 0) & (hits >= F.lit(share) * F.size(words))


def best_split(part: str, found: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable split of ``part`` into words: a known word has its share
    of all words, an unknown one of any length a share that falls tenfold with
    each letter. The best start of an unknown word is the same for every end,
    so it is carried along; ties go to the later start."""
    log_total, letter = math.log(max(total, 1) + 1), math.log(10)
    ending = {}
    for (start, length), n in found.items():
        ending.setdefault(start + length, []).append((start, math.log(n) - log_total))
    score, back, unknown = [0.0], [0], (0.0, 0)
    for end in range(1, len(part) + 1):
        best = (unknown[0] - log_total - end * letter, unknown[1])
        for start, p in ending.get(end, ()):
            best = max(best, (score[start] + p, start))
        score.append(best[0])
        back.append(best[1])
        unknown = max(unknown, (best[0] + end * letter, end))
    words, end = [], len(part)
    while end:
        words.append(part[back[end]:end])
        end = back[end]
    return words[::-1]


def host_words(hosts: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, words): the words of each different host. Every substring of a
    name meets the word counts in a join, so no task holds the vocabulary."""
    names = hosts.select("host", F.posexplode(F.split("host", "[^a-z]+")).alias("at", "part")).filter("part <> ''")
    parts = names.select("part").distinct()
    starts = parts.select("part", F.explode(F.sequence(F.lit(0), F.length("part") - 1)).alias("start"))
    pieces = starts.select("part", "start", F.explode(F.sequence(F.lit(1), F.least(
        F.lit(MAX_WORD), F.length("part") - F.col("start")))).alias("len"))
    pieces = pieces.withColumn("word", F.substring("part", F.col("start") + 1, F.col("len")))
    found = (pieces.join(counts, "word").groupBy("part")
             .agg(F.collect_list(F.struct("start", "len", "n")).alias("found")))

    def split(batches):
        for b in batches:
            out = [best_split(p, {(f["start"], f["len"]): f["n"] for f in found or []}, total)
                   for p, found in zip(b.column("part").to_pylist(), b.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("part"), pa.array(out, pa.list_(pa.string()))],
                                             names=["part", "words"])

    cut = parts.join(found, "part", "left").select("part", "found").mapInArrow(split, "part string, words array<string>")
    return (names.join(cut, "part").groupBy("host")
            .agg(F.sort_array(F.collect_list(F.struct("at", "words"))).alias("w"))
            .select("host", F.flatten(F.col("w.words")).alias("words")))


def path_words(path: Column) -> Column:
    """Lower-case letter runs and, for any digits, one mark for a number of that length."""
    lower = F.regexp_replace(F.lower(path), r"\d", "0")
    return F.transform(F.regexp_extract_all(lower, F.lit(r"(\p{L}+|0+)"), F.lit(1)), lambda w: F.concat(F.lit("/"), w))


def filter_urls(pages: DataFrame, rules: Sequence[Rule], seeds: Sequence[str] = SEEDS, id_col: str = "page_id", url_col: str = "url",
                html_col: str = "html", text_share: float = SEED_TEXT) -> DataFrame:
    """page_id, host, path, rule, verdict, score, words for every row.

    ``rules`` are (verdict, host, path) with verdict allow or block; they and
    the seed words are settings and go into the plan. ``score`` is the log odds
    of allow, null where a rule decides. A null URL, or one without ://, has an
    empty host and path and is judged by the shares of the examples alone; with
    no example to block, every page is allowed. A null or empty text has no words;
    texts, URLs and words count whole, whatever their length. Null ids and repeated
    rows stay as they are, each an example; a score of exactly 0 allows. Other
    columns of ``pages`` are not read; an empty table gives no rows."""
    url = F.col(url_col).cast("string")
    base = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"),
                        seeded_text(F.col(html_col).cast("string"), seeds, text_share).alias("seeded"))
    base = staged(base.withColumn("rule_no", rule_for(F.col("host"), F.col("path"), rules)), "urls")
    counts = staged(word_counts(F.col(html_col).cast("string"), pages), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    marks = pages.sparkSession.createDataFrame([(w, total // SEED_SHARE + 1) for w in seeds], "word string, n long")
    counts = counts.unionByName(marks).groupBy("word").agg(F.sum("n").alias("n"))
    split = staged(host_words(base.select("host").distinct(), counts, total), "hosts")

    urls = base.groupBy("host", "path", "rule_no").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("seeded").alias("seeded"))
    known = F.coalesce("words", F.array().cast("array<string>"))
    marked = F.arrays_overlap(known, F.array(*[F.lit(w) for w in seeds]).cast("array<string>"))
    urls = staged(urls.join(split, "host", "left").select(
        "host", "path", "rule_no", "n", F.concat(known, path_words(F.col("path"))).alias("words"),
        F.when(marked, F.col("n")).otherwise(F.col("seeded")).alias("bad")), "url-words")
    of_good, of_bad = F.col("n") - F.col("bad"), F.col("bad")
    weights = staged(urls.select(F.explode("words").alias("word"), "bad", "n").groupBy("word")
                     .agg(F.sum(of_good).alias("a"), F.sum(of_bad).alias("b")), "url-weights")
    a, b, vocabulary = weights.agg(F.sum("a"), F.sum("b"), F.count(F.lit(1))).first()
    good, bad = urls.agg(F.sum(of_good), F.sum(of_bad)).first()
    prior = math.log(((good or 0) + 1) / ((bad or 0) + 1))
    slack = math.log(((b or 0) + (vocabulary or 0) + 1) / ((a or 0) + (vocabulary or 0) + 1)) if bad else 0.0
    weights = weights.select("word", (F.log((F.col("a") + 1) / (F.col("b") + 1)) + slack).alias("w"))
    open_urls = urls.filter("rule_no is null").select("host", "path", F.explode("words").alias("word"))
    scores = (open_urls.join(weights, "word").groupBy("host", "path").agg(F.sum("w").alias("s")))
    judged = staged(urls.filter("rule_no is null").join(scores, ["host", "path"], "left")
                    .select("host", "path", "words",
                            (F.coalesce("s", F.lit(0.0)) * (1 if bad else 0) + prior).alias("score")), "url-scores")
    names = F.get(F.array(*[F.lit(h + p) for _, h, p in rules]), F.col("rule_no")) if rules else F.lit(None)
    verdict = F.get(F.array(*[F.lit(v) for v, _, _ in rules]), F.col("rule_no")) if rules else F.lit(None)
    return (base.join(judged, ["host", "path"], "left")
            .select("page_id", "host", "path", names.cast("string").alias("rule"),
                    F.coalesce(verdict.cast("string"), F.when(F.col("score") >= 0, "allow").otherwise("block"))
                    .alias("verdict"), "score", "words"))
