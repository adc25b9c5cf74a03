"""URL filter: rules by host and path, else logistic regression on hashed character n-grams.

The n-grams are those of host and of path, in ranges of their own of one hashed table. The
regression is fitted on the driver from a small labelled URL table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, lower_az
from .training import minimise, sigmoid

#: (host, path, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
BUCKETS, SIZES = 1 << 16, (3, 4, 5)
#: So much decay, as the part of a third of the table's names left out is told best with it.
DECAY = 1e-5

#: Words of which the small labelled table's names are made: of sites to block, and of others.
_BLOCK_WORDS = (
    "spammer spamming scam scammer cheapest pharma pharmacy viagra xanax tramadol casinos slots roulette blackjack poker jackpot betting bettor sportsbook wager gambling gamble winner winnings bonus lottery lotto sweepstake prizes "
    "adults xxx porn pornstar sexy nude cams escort hookup dating adserver advert adverts popup popunder clickbait tracker tracking affiliate freebie freebies giveaway discounts replica counterfeit knockoff payday loans "
    "moneymaker millionaire richquick doubling investor forex binary profits malware virus phish phishing hacked hacking cracked keygen warez torrent pirated botnet backlink linkbuilding fatburner slimming detox miracle cureall pillbox steroid singles onlyfans livecam striptease cashback getrich earnings pyramid ponzi airdrop nft whitelist presale bitcoins cryptos dogecoin luckyday megawin freeroll freespins wagers bookmaker tipster odds clicker pixeltrack adnetwork adtracker popads cheapo discounted pilule painkiller opioid spamming spambot junkmail spammy linkfarm contentfarm loseweight fatloss casinobonus hottest winning winfast"
).split()
_ALLOW_WORDS = (
    "library news museum university college school academy institute garden weather science physics chemistry biology recipes kitchen cooking bakery history heritage archive maps atlas forum docs manual guide wiki encyclopedia "
    "dictionary music orchestra concert travel railway airport council city town village parish theatre opera cinema nature wildlife forest river mountain ocean journal review magazine gazette times herald post tribune books "
    "reading poetry writers gallery design studio hospital clinic health nursing charity foundation society sports football cricket tennis cycling running climate energy water engineering software code developer research "
    "laboratory observatory astronomy geology farmers market bank insurance law court justice parliament government ministry embassy office teacher student children family parents community church stadium harbour bridge castle"
).split()
#: Letters of which invented names are made, to be allowed.
_CONSONANTS, _VOWELS = "b c d f g h j k l m n p r s t v w z ch sh st th tr".split(), "a e i o u ai ea io ou".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 to block): names of one to three words of a class, and invented ones, below usual prefixes and domains, with paths of one kind for both classes."""
    ends, before = ("example.com", "example.net", "example.org", "test"), ("", "www.", "m.", "blog.", "shop.")
    rng = np.random.default_rng(0)

    def names(words: list[str], n: int) -> list[str]:
        chosen = [[words[i] for i in rng.integers(0, len(words), size)] for size in rng.choice([2, 2, 2, 3], n)]
        return [*words, *(rng.choice(["-", "-", ""]).join(c) for c in chosen if len(set(c)) == len(c))]

    def invented() -> str:
        return "".join(rng.choice(_CONSONANTS) + rng.choice(_VOWELS) * (rng.random() < 0.7) + rng.choice(["n", "r", "s", "l", ""]) for _ in range(rng.integers(2, 5)))

    def path(words: list[str]) -> str:
        a, b = rng.integers(0, len(words), 2)
        n = rng.integers(1, 100_000)
        return str(rng.choice(["/", "", f"/{n}", f"/{n}.html", f"/{words[a]}", f"/{words[a]}-{words[b]}/{n}", f"/p/{n}/", f"/it/{n}", "/index.html"]))

    out = []
    for hosts, y in ((names(_BLOCK_WORDS, 1200), 1), (names(_ALLOW_WORDS, 500) + [invented() for _ in range(700)], 0)):
        for i, h in enumerate(hosts):
            out += [(f"{before[(i + j) % 5]}{h}.{end}", path(_BLOCK_WORDS if y else _ALLOW_WORDS), y) for j, end in enumerate(ends[i % 2 :: 2])]
    return out


def ngram_buckets(hosts: Sequence[str], paths: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket): the distinct buckets of each row's n-grams of host and of path, each between end marks, for all rows at once."""
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for seed, parts in ((1, hosts), (2, paths)):
        texts = [f"^{p}$".encode("utf-8", "surrogatepass") for p in parts]
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"".join(texts), np.uint8).astype(np.uint64)
        row, left = np.repeat(np.arange(len(texts)), size), np.repeat(np.cumsum(size), size) - np.arange(len(data))
        for n in (n for n in SIZES if len(data) >= n):
            code = np.full(len(data) - n + 1, seed, np.uint64)
            for i in range(n):
                code = code * np.uint64(257) + data[i : len(data) - n + 1 + i]
            whole = left[: len(code)] >= n
            # Fibonacci hashing: the product's high bits
            rows.append(row[: len(code)][whole])
            found.append((code[whole] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(48)).astype(np.int64))
    pairs = np.unique(np.concatenate(rows) * BUCKETS + np.concatenate(found))
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Logistic:
    weights: np.ndarray
    bias: float

    def scores(self, hosts: Sequence[str], paths: Sequence[str]) -> np.ndarray:
        """The chances that the URLs are to be blocked, from the sum over n-grams divided by the root of their number."""
        row, bucket = ngram_buckets(hosts, paths)
        n = np.bincount(row, minlength=len(hosts))
        return sigmoid(self.bias + np.bincount(row, self.weights[bucket], len(hosts)) / np.sqrt(np.maximum(n, 1)))

    def score(self, host: str, path: str) -> float:
        return float(self.scores([host], [path])[0])


def fit(table: list[tuple[str, str, int]], steps: int = 400, decay: float = DECAY) -> Logistic:
    row, bucket = ngram_buckets([h for h, _, _ in table], [p for _, p, _ in table])
    used, col = np.unique(bucket, return_inverse=True)
    value = 1 / np.sqrt(np.bincount(row, minlength=len(table)))[row]
    y = np.array([t[2] for t in table], float)

    def slope(p, _):
        g = (sigmoid(np.bincount(row, p[0][col] * value, len(y)) + p[1][0]) - y) / len(y)
        return [np.bincount(col, g[row] * value, len(used)) + decay * p[0], np.array([g.sum()])]

    w, b = minimise([np.zeros(len(used)), np.zeros(1)], slope, steps, 0.2)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return Logistic(weights, float(b[0]))


@lru_cache(1)
def default_model() -> Logistic:
    return fit(labelled_urls())


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = lower_az(F.regexp_extract(rest, r"\A([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, url: str = "url", rules: tuple = RULES, model: Logistic | None = None, threshold: float = 0.5) -> DataFrame:
    """The input's rows and columns plus host, path, rule, verdict and block_score.

    The longest fitting rule decides (of equally long ones the first named); block_score is the
    regression's, null where a rule decides. A null url, or one without `://`, has an empty host and
    path, which the regression judges like any other. Columns of these names are replaced; repeated
    rows stay and no rows give none. One pass over the pages: rows that a rule decides come to
    Python as nulls.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model or default_model())

    @F.pandas_udf("double")
    def score(host, path):
        import pandas as pd

        out = pd.Series(np.nan, index=host.index)
        asked = host.notna()
        if asked.any():
            out[asked] = shared.value.scores(host[asked].tolist(), path[asked].tolist())
        return out.astype("Float64").mask(~asked)

    host, path = host_and_path(F.col(url))
    at, got = fresh(pages, "at", "got")
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for h, p, v in reversed(sorted(rules, key=lambda r: -len(r[0] + r[1]))):
        fits = ((F.col(f"{at}.host") == h) | F.endswith(f"{at}.host", F.lit("." + h))) & F.startswith(f"{at}.path", F.lit(p))
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))).otherwise(found)
    out = pages.withColumn(at, F.struct(host.alias("host"), path.alias("path"))).withColumn(got, found)
    asked = F.col(got).isNull()
    new = {
        "host": F.col(f"{at}.host"), "path": F.col(f"{at}.path"), "rule": F.col(f"{got}.rule"),
        "block_score": score(F.when(asked, F.col(f"{at}.host")), F.when(asked, F.col(f"{at}.path"))),
    }
    out = out.select(*(c for c in pages.columns if c.lower() not in {*new, "verdict"}), *(c.alias(n) for n, c in new.items()), got)
    return out.withColumn("verdict", F.coalesce(f"{got}.verdict", F.when(F.col("block_score") >= threshold, "block").otherwise("allow"))).drop(got)


def url_digest(pages: DataFrame) -> DataFrame:
    """The query's rows: page_id, host, path, rule, verdict."""
    return judged(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
