"""URL filters: rules by host and path, and where none fits, logistic regression on hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import mixed, prepare

BUCKETS = 1 << 14
SIZES = (3, 4, 5)
#: Subdomains that say nothing about a host.
SUBDOMAINS = ("", "www.", "m.", "blog.")
#: Bytes of URLs whose n-grams are held at once (a longer URL alone).
TOGETHER = 1 << 18

# The labelled table that the model is trained on (invented hosts of the kinds that blocklists and allowlists hold).
BLOCKED = """royal-casino.example/slots lucky-casino.example/bonus online-casino.example/en/play casino24.example/jackpot casino-vegas.example/es/4
grand-casino.example/ poker-slots.example/join jackpot-spins.example/now free-spins.example/fr/7 win-big.example/claim lottery-wins.example/ticket
sports-bets.example/today bets365.example/live bets-today.example/odds betting-tips.example/de/ livebets.example/12 free-poker.example/start
cheap-meds.example/buy pills-online.example/viagra diet-pills.example/en/33 sleeping-pills.example/order viagra-shop.example/cheap
discount-pharma.example/pills cheap-viagra.example/5.html cheap-loans.example/fast payday-loans.example/apply replica-watches.example/cheap
adult-cams.example/live adult-dating.example/en/9 hot-adult.example/x adult-videos.example/ xxx-tube.example/watch x-porn.example/free
sex-chat.example/girls escort-girls.example/2.html free-porn.example/de/81 ads-network.example/banner ads-exchange.example/pixel best-ads.example/es/19
ad-server.example/img adtracker.example/click pixel-track.example/beacon click-track.example/redirect tracking.example/event popup-ads.example/
spam-links.example/buy seo-spam.example/en/2 spam-mail.example/send spam4u.example/fr/6.html www.spam-blog.example/de/4 link-farm.example/seo
content-farm.example/spun backlinks-farm.example/cheap like-farm.example/es/8 click-farm.example/en/9 adult-toys.example/en/3 m.adultchat.example/es/2
superpills.example/shop buypills.example/fr/1 ads-center.example/js cheapads.example/es/show allbets.example/en/8 luckybets.example/slip
crypto-giveaway.example/claim free-iphone.example/win hack-tools.example/keygen warez-crack.example/serial torrent-crack.example/keygen""".split()
ALLOWED = """news.example/world/article weather.example/today blog.gardening.example/roses docs.library.example/manual www.university.example/research
museum.example/exhibits school.example/classes city-council.example/meetings recipes.example/soup history.example/rome en.encyclopedia.example/wiki
forum.bikes.example/repair www.hospital.example/visitors travel.example/guides/alps m.daily-post.example/politics science.example/journal/12
code.example/project/readme www.theatre.example/programme art.example/gallery books.example/reviews/2020 www.river.example/en/walks
mountain.example/en/huts/8 m.evening-times.example/fr/sport blog.kitchen.example/de/bread www.harbour.example/es/boats.html village.example/en/fair
therapy.example/help shop.example/garden/tools local.example/events/may music.example/albums animals.example/horses www.athletics.example/results
addresses.example/list www.adults-education.example/courses pharmacy.example/opening-hours winter.example/sports better-living.example/home
www.window.example/frames blog.sandwich.example/lunch thanks.example/de/cards www.station.example/fr/trains nation.example/es/laws
thoughts.example/en/5 earth.example/en/soil/44 northern.example/de/lights.html another.example/fr/view/3 lantern.example/es/light/ www.orchard.example/en/apples
blog.weather-house.example/de/rain m.thunder.example/en/storm think.example/en/1 together.example/en/people mention.example/fr/words""".split()

# Verdict, host and path. A rule fits its host and all subdomains where the path begins with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to /, ?, # or the end, A-Z lower-cased. Path: from there up to ?, # or the end."""
    there = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.when(there, F.translate(host, upper, lower)).otherwise(""), F.when(there, path).otherwise("")


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Of all texts: row and bucket of their distinct n-grams."""
    marked = [b"^" + t + b"$" for t in texts]
    own = np.frombuffer(b"".join(marked), np.uint8).astype(np.uint64)
    row = np.repeat(np.arange(len(marked)), [len(t) for t in marked])
    keys = []
    for n in SIZES:
        m = max(len(own) - n + 1, 0)
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(257) + own[k : k + m]
        inside = row[:m] == row[n - 1 : n - 1 + m]
        keys.append(row[:m][inside] * BUCKETS + (mixed(h[inside]) % np.uint64(BUCKETS)).astype(np.int64))
    key = np.unique(np.concatenate(keys))
    return key // BUCKETS, key % BUCKETS


class UrlModel:
    """Logistic regression over the n-grams that host and path have. What a URL has besides doesn't weaken them."""

    def __init__(self, blocked: list[str] = BLOCKED, allowed: list[str] = ALLOWED, rounds: int = 400):
        own = [[self.cut(u) for u in urls] for urls in (blocked, allowed)]
        rows: list[tuple[str, str, float]] = []
        for cuts, others, y in ((own[0], own[1], 1.0), (own[1], own[0], 0.0)):
            for k, (host, path) in enumerate(cuts):
                # once more by the host alone, and under each subdomain with a path of the other kind, so that neither stands for the host
                rows += [(host, path, y), (host, "", y), *((sub + host, others[(k + n) % len(others)][1], y) for n, sub in enumerate(SUBDOMAINS) if others)]
        y = np.array([r[2] for r in rows])
        row, at = grams([self.shown(h, p) for h, p, _ in rows])
        self.w = np.zeros(BUCKETS + 1)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-(np.bincount(row, self.w[at], minlength=len(y)) + self.w[-1])))
            gap = (p - y) / len(y)
            self.w -= 0.5 * (np.append(np.bincount(at, gap[row], minlength=BUCKETS), gap.sum()) + 1e-3 * np.append(self.w[:-1], 0))

    @staticmethod
    def cut(url: str) -> tuple[str, str]:
        host, slash, path = url.partition("/")
        return host, slash + path

    @staticmethod
    def shown(host: str, path: str) -> bytes:
        """What the n-grams are taken from: the host without its top-level name, and the path's letters."""
        return (host.rpartition(".")[0] + "|" + path).encode()

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Each URL's chance of block."""
        texts = [self.shown(h, p) for h, p in zip(hosts, paths)]
        out, begin, size = [np.zeros(0)], 0, 0
        for k, t in enumerate(texts):
            size += len(t)
            if size >= TOGETHER or k == len(texts) - 1:
                row, at = grams(texts[begin : k + 1])
                out.append(1 / (1 + np.exp(-(np.bincount(row, self.w[at], minlength=k + 1 - begin) + self.w[-1]))))
                begin, size = k + 1, 0
        return np.concatenate(out)


def filter_urls(pages: DataFrame, rules=RULES, model: UrlModel | None = None, threshold: float = 0.5, url_col: str = "url") -> DataFrame:
    """pages with host, path, rule (of the longest rule that fits, host and path joined; else null), score and verdict.

    score is the model's chance of block where no rule fits, else null; from threshold on the verdict is block. Null
    URLs and those without :// have an empty host and path and are judged like any other. Repeated rows are judged alike;
    an empty table gives no rows. Columns of pages with the new names are replaced. rules may be a few hundred: they
    become one expression.
    """
    prepare(pages.sparkSession)
    model = model or UrlModel()
    out = pages.drop("host", "path", "rule", "score", "verdict")
    host, path = host_and_path(F.col(url_col))
    out = out.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):  # the longest is tried first, so it is put last
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)

    def judge(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for hosts, paths, ruled in batches:
            open_ = np.flatnonzero(np.array(ruled.is_null(), bool))
            scores = np.full(len(ruled), np.nan)
            scores[open_] = model.scores(hosts.take(open_).to_pylist(), paths.take(open_).to_pylist())
            yield pa.array(scores, pa.float64(), from_pandas=True)

    judge.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    out = out.withColumns({"rule": rule, "verdict": verdict})
    out = out.withColumn("score", arrow_udf(judge, "double")("host", "path", "rule"))
    return out.withColumn("verdict", F.coalesce("verdict", F.when(F.col("score") >= threshold, "block").otherwise("allow")))
