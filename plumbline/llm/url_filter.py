"""URL filters: host and path rules first, a character n-gram classifier for the rest.

A rule fits its host and that host's subdomains where the path starts with the
rule's; the longest rule wins.  URLs without a rule go to a logistic regression
over hashed character n-grams of host and path, trained in numpy on the small
labelled table below.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and is judged by the classifier; of rules of equal length the first
in alphabetical order wins; URLs of any length are read whole; repeated rows are
judged one by one; an empty table gives an empty result; columns named like a
result are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shielded

#: Rules of the registered query: (host with path, verdict).
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

# The labelled URLs, as host and path; written for this list, under the reserved top level ``test``.
BLOCKED = """
casino-win.test/en/12 free-bets.test/en/7 cheap-pills.test/de/3 ads-track.test/en/9
www.casino-royal.test/play/77 m.best-casino.test/slots/1 slots-online.test/jackpot bet-bonus.test/sports/5
sports-betting.test/odds/33 poker-win.test/en/2 lotto-prizes.test/win/11 free-spins.test/bonus
pills-online.test/buy/viagra cheap-viagra.test/order pharmacy-discount.test/pills/8 buy-cialis.test/cheap
weight-loss-pills.test/offer diet-miracle.test/buy-now ads.server.test/banner/1 adserver.test/click/22
tracker.ads.test/pixel.gif click-track.test/redirect/3 popup-ads.test/en/4 banner-ads.test/view/6
doubleads.test/impression xxx-videos.test/watch/1 porn-tube.test/video/9 adult-cams.test/live/3
sex-dating.test/join hot-singles.test/meet free-iphone.test/winner prize-winner.test/claim
get-rich-quick.test/now crypto-profit.test/signup payday-loans.test/apply fast-cash.test/loan/2
replica-watches.test/shop/1 cracked-software.test/keygen warez-downloads.test/full torrent-free.test/dl/5
win-money.test/en/8 free-gift-cards.test/claim cheap-meds.test/de/4 online-gambling.test/fr/6
spam-mailer.test/list spam-farm.test/en/2 link-farm.test/seo/4 malware-site.test/exe phishing-login.test/verify escort-service.test/city/2
""".split()
ALLOWED = """
quillmark.test/en/12 harborview.test/en/7 oldbridge.test/en/3 www.stonegate.test/fr/9
blog.northfield.test/en/77 m.silverlake.test/es/1 greenhill.test/de/20 www.fairmont.test/en/5
news.daily.test/world/33 www.city-library.test/books/2 museum.test/collection/11 university.test/research/paper
school.test/teachers/8 docs.software.test/guide/install wiki.science.test/physics/light weather.test/forecast/4
recipes.test/bread/22 garden.test/plants/roses travel.test/guide/rome history.test/medieval/castles
health.test/exercise/walking hospital.test/departments/1 council.test/planning/6 parliament.test/debates/9
music.test/concerts/3 orchestra.test/programme theatre.test/season/2 film.test/reviews/15
bank.test/about railway.test/timetable/8 airport.test/arrivals post.test/parcels/7
blog.writer.test/essays/1 forum.cycling.test/topic/44 chess.test/openings/5 hiking.test/trails/10
birds.test/species/owl astronomy.test/planets/mars maths.test/proofs/primes biology.test/cells/12
shop.books.test/fiction/3 market.test/vegetables/2 architecture.test/bridges/6 radio.test/schedule/4
charity.test/projects/1 court.test/judgments/19 statistics.test/census/8 patents.test/search/5
""".split()


@dataclass(frozen=True)
class Params:
    bits: int = 14
    sizes: tuple[int, ...] = (3, 4, 5)
    l2: float = 1e-3
    rounds: int = 400
    rate: float = 0.5
    threshold: float = 0.5


def host(url: str = "url") -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str = "url") -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule(rules: tuple[tuple[str, str], ...]) -> Column:
    """The struct (rule, verdict) of the longest rule that fits, else null.

    One CASE over the rules: meant for lists of up to a few hundred.
    """
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        domain, slash, rest = text.partition("/")
        fits = ((F.col("host") == domain) | F.col("host").endswith("." + domain)) & F.col("path").startswith(slash + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: str, path: str, params: Params) -> list[int]:
    """The hashed character n-grams of host and path, each once."""
    mask = (1 << params.bits) - 1
    out = set()
    for name, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        raw = text.encode("utf-8", "replace")
        seed = crc32(name.encode())
        for k in params.sizes:
            out.update(crc32(raw[i : i + k], seed) & mask for i in range(len(raw) - k + 1))
    return sorted(out)


def train(blocked: list[str], allowed: list[str], params: Params = Params()) -> tuple[np.ndarray, float]:
    """Weights and bias of the logistic regression; labels are equally heavy."""
    rows = []
    for url in [*blocked, *allowed]:
        domain, slash, rest = url.partition("/")
        rows.append(grams(domain, slash + rest, params))
    y = np.array([1.0] * len(blocked) + [0.0] * len(allowed))
    share = np.where(y > 0, 0.5 / max(1, len(blocked)), 0.5 / max(1, len(allowed)))
    index = np.concatenate([np.array(r, np.int64) for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = 1 / np.sqrt(np.array([max(1, len(r)) for r in rows]))
    w, b = np.zeros(1 << params.bits), 0.0
    for _ in range(params.rounds):
        z = np.bincount(row, w[index] * scale[row], len(rows)) + b
        g = share * (1 / (1 + np.exp(-z)) - y)
        w -= params.rate * len(rows) * (np.bincount(index, g[row] * scale[row], len(w)) / len(rows) * 4 + params.l2 * w / len(rows))
        b -= params.rate * g.sum()
    return w, b


@cache
def model(params: Params = Params()) -> tuple[np.ndarray, float]:
    return train(BLOCKED, ALLOWED, params)


def score(host: str, path: str, params: Params = Params()) -> float:
    """How likely the URL is to be blocked, from 0 to 1."""
    w, b = model(params)
    g = grams(host, path, params)
    return float(1 / (1 + np.exp(-(w[g].sum() / np.sqrt(max(1, len(g))) + b))))


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, params: Params = Params()) -> DataFrame:
    """``pages`` with host, path, rule, verdict and, where no rule fits, the classifier's score."""

    @F.pandas_udf("double")
    def scored(hosts: pd.Series, paths: pd.Series, open_: pd.Series) -> pd.Series:
        return pd.Series([score(h, p, params) if o else None for h, p, o in zip(hosts, paths, open_, strict=True)], dtype="float64")

    made = ("host", "path", "rule", "verdict", "score")
    own, back = shielded(pages.select("url", *[F.col(f"`{c}`") for c in pages.columns if c not in (*made, "url")]), ("url",))
    df = own.withColumns({"host": host(), "path": path()})
    df = df.withColumn("fit", rule(rules))
    df = df.withColumn("score", scored("host", "path", F.col("fit").isNull()))
    by_model = F.when(F.col("score") >= params.threshold, "block").otherwise("allow")
    df = df.withColumn("rule", F.col("fit.rule")).withColumn("verdict", F.coalesce("fit.verdict", by_model))
    return back(df, made)
