"""Host words and URL scores against brute force; hosts without a seed word."""

import math
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F

from cyclewise.llm import url_filter


def probability(words, part_found, total):
    at, p = 0, 0.0
    for w in words:
        n = part_found.get((at, len(w)))
        p += (math.log(n) if n else -len(w) * math.log(10)) - math.log(total + 1)
        at += len(w)
    return p


def splits(part):
    for k in range(len(part)):
        for cuts in combinations(range(1, len(part)), k):
            edges = [0, *cuts, len(part)]
            yield [part[a:b] for a, b in zip(edges, edges[1:])]


def test_split_is_the_most_probable_of_all():
    counts = {"the": 50, "rest": 9, "there": 20, "st": 2, "he": 30, "t": 1, "her": 12, "res": 1}
    for part in ("therest", "hethere", "xtherez", "tttt", "qqqzzz", "a", "theresthe"):
        found = {(i, len(w)): n for w, n in counts.items() for i in range(len(part)) if part.startswith(w, i)}
        for total in (0, 200, 10 ** 9):
            got = url_filter.best_split(part, found, total)
            best = max(probability(s, found, max(total, 1)) for s in splits(part))
            assert "".join(got) == part
            assert math.isclose(probability(got, found, max(total, 1)), best, abs_tol=1e-9)


def test_long_words_stay_whole():
    assert url_filter.best_split("z" * 5000, {}, 100) == ["z" * 5000]
    assert url_filter.best_split("abc" + "y" * 40, {(3, 40): 7}, 100) == ["abc", "y" * 40]


PLAIN = "<p>fresh news of the daily bread lucky spin farm cheap watches " * 4 + "</p>"
VICE = "<script>fresh</script><p>casino poker slots and lucky spin jackpot tonight</p>"
PAGES = ([(i, f"http://freshnews.org/daily/{i}", PLAIN) for i in range(30)]
         + [(100 + i, f"http://cheap-pills.net/buy/{i}", PLAIN) for i in range(6)]
         + [(200 + i, f"http://luckyspin.org/play/{i}", VICE) for i in range(6)]
         + [(300, "http://luckyspin.org/about", PLAIN), (301, "http://cheapwatches.net/buy/9", PLAIN),
            (302, "http://dailybread.org/poker", None), (303, None, VICE), (303, None, VICE), (None, "http://news.org", ""),
            (304, "http://" + "q" * 3000 + ".org/" + "p" * 100_000, "x" * 300_000)])


def brute_scores():
    """Log odds by (host, path), from the words that the filter returns."""
    good, bad, examples = Counter(), Counter(), [0, 0]
    seeds = set(url_filter.SEEDS)

    def label(words, html):
        text = re.sub(r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ", html or "")
        letters = re.findall("[a-z]+", text.lower())
        hits = sum(w in seeds for w in letters)
        return bool(seeds & set(words)) or 0 < hits and hits >= url_filter.SEED_TEXT * len(letters)

    def learn(rows):
        for words, html in rows:
            block = label(words, html)
            examples[block] += 1
            (bad if block else good).update(words)
        size, a, b = len(set(good) | set(bad)), sum(good.values()), sum(bad.values())
        prior = math.log((examples[0] + 1) / (examples[1] + 1))
        return lambda words: prior + sum(
            math.log((good[w] + 1) / (a + size + 1)) - math.log((bad[w] + 1) / (b + size + 1)) for w in words)
    return learn


def test_scores_and_hosts_without_a_seed(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    clash = df.withColumn("host", F.lit("x")).withColumn("words", F.lit(1)).withColumn("seeded", F.lit(True))
    got = url_filter.filter_urls(clash, []).collect()
    assert len(got) == len(PAGES)
    html = {(i, u): h for i, u, h in PAGES}
    urls = {(url_filter_host(u), url_filter_path(u), i): h for (i, u), h in html.items()}
    score = brute_scores()([(r.words, urls[r.host, r.path, r.page_id]) for r in got])
    for r in got:
        assert math.isclose(r.score, score(r.words), rel_tol=1e-9, abs_tol=1e-9)
        assert r.verdict == ("allow" if r.score >= 0 else "block")
    verdict = {r.page_id: r.verdict for r in got}
    words = {r.page_id: r.words for r in got}
    assert words[301][:2] == ["cheap", "watches"] and not set(words[301]) & set(url_filter.SEEDS)
    assert verdict[301] == "block"                      # for words it shares with a host that has a seed
    assert verdict[200] == verdict[300] == "block"      # for the texts of its host's pages
    assert verdict[0] == verdict[302] == verdict[None] == "allow"
    assert words[304][0] == "q" * 3000 or "".join(words[304]).startswith("q" * 3000)


def url_filter_host(url):
    m = re.match(r"(?s).*?://([^/?#]*)", url or "")
    return m.group(1).lower() if m else ""


def url_filter_path(url):
    m = re.match(r"(?s).*?://[^/?#]*([^?#]*)", url or "")
    return m.group(1) if m else ""
