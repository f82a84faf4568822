"""Operator 5: URL verdicts from rules, and otherwise from a logistic regression.

Rules are pairs of host and path; one fits its host and all subdomains if the url's path
starts with the rule's, and the longest that fits decides.  Urls that no rule fits get
the verdict of a logistic regression on hashed character n-grams of host and path, which
is trained here from a small labelled table of urls.

Cases: a null url, or one without ``://``, has an empty host and path and is scored as
such; ids that repeat or are null are judged row by row; an empty table gives no rows;
other columns are not carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed

#: (host, path, verdict)
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
#: A small labelled table, written for this module: names that lists of unwanted sites and of public institutions are full of,
#: under domains that are reserved for examples.
LABELLED = (
    [(u, 1) for u in (
        "https://mega-jackpot.test/en/spin", "http://www.lucky-slots.test/de/bonus", "https://roulette-royal.test/play?ref=9", "http://m.blackjack-vip.test/fr/12",
        "https://casino-jackpots.test/es/free", "http://betting-tips.test/odds", "https://www.sportsbet-bonus.test/en/signup", "http://poker-chips.test/de/4",
        "https://viagra-discount.test/buy", "http://weightloss-pills.test/order?id=7", "https://www.meds-without-prescription.test/fr/shop", "http://cheap-steroids.test/es/3",
        "https://xxx-webcams.test/en/live", "http://hot-adult-dating.test/de/chat", "https://www.sexy-singles.test/join", "http://porn-movies.test/watch/88",
        "https://adult-toys.test/fr/sale", "http://nude-cams.test/es/room/5", "https://warez-keygen.test/crack/7", "http://free-torrents.test/download.php?f=2",
        "https://serial-crack.test/en/get", "http://www.pirated-movies.test/stream", "https://payday-loan-fast.test/apply", "http://instant-cash-advance.test/en/form",
        "https://bad-credit-loans.test/de/", "http://forex-profit.test/win", "https://crypto-doubler.test/invest?x=2", "http://get-rich-quick.test/es/secret",
        "https://replica-rolex.test/sale", "http://fake-handbags.test/fr/7", "https://buy-likes.test/en/1000", "http://cheap-backlinks.test/seo",
        "https://traffic-exchange.test/click", "http://adclick-track.test/pixel.gif", "https://popunder-ads.test/serve", "http://spam-blaster.test/mail",
        "https://link-exchange.test/farm/12", "http://prize-winner.test/claim?u=5", "https://free-giftcards.test/survey", "http://lottery-claims.test/fr/winner",
    )]
    + [(u, 0) for u in (
        "https://www.city-library.test/en/catalogue", "http://archive.national-museum.test/de/room/4", "https://courses.open-university.test/en/algebra", "http://news.daily-courier.test/fr/2019/11",
        "https://www.weather-office.test/es/map", "http://health.ministry.test/en/advice", "https://docs.compiler-project.test/guide.html", "http://wiki.gardeners.test/en/roses",
        "https://recipes.grandmother.test/fr/soupe", "http://www.railway-timetable.test/de/", "https://history-society.test/en/article/31", "http://school-district.test/es/alumnos",
        "https://blog.astronomer.test/en/2020/03", "http://forum.woodwork.test/de/thread/77", "https://www.parliament.test/fr/lois", "http://data.statistics-bureau.test/en/table/5",
        "https://radio.orchestra.test/es/concierto", "http://philosophy-journal.test/en/issue/12", "https://www.hiking-club.test/de/tour", "http://maths-notes.test/en/page/9",
        "https://travel.old-town.test/fr/rue", "http://community-theatre.test/en/season", "https://www.children-hospital.test/es/", "http://code.open-source.test/project/readme",
        "https://m.evening-post.test/en/story/412", "http://www.book-review.test/de/roman", "https://botany.herbarium.test/fr/fleur", "http://chess-federation.test/en/games",
        "https://www.sea-rescue.test/es/costa", "http://water-works.test/de/netz", "https://teachers.lessons.test/en/plan.html", "http://old-maps.test/fr/carte/8",
        "https://www.village-choir.test/en/", "http://birdwatch.test/es/aves", "https://engineering.bridge.test/de/bau", "http://poets-corner.test/en/verse/3",
        "https://linguistics.dialect.test/fr/mot", "http://www.farm-cooperative.test/en/harvest", "https://law.court-reports.test/es/caso", "http://notes.physics-lab.test/en/lab/2",
    )]
)
BUCKETS = 1 << 14
GRAMS = (3, 4, 5)
#: Urls that are scored together.
URLS = 1000


def split_url(url: str | None) -> tuple[str, str]:
    """Host, A-Z lower-cased, and path."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, rest = rest[:at], rest[at:]
    at = min((i for i in map(rest.find, "?#") if i >= 0), default=len(rest))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), rest[:at]


class Rules:
    """Rules by host; a url asks for its host and each domain above it."""

    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            self.by_host.setdefault(host, []).append((path, verdict))

    def longest(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict)"""
        best, at = None, 0
        while at >= 0:
            domain = host[at:]
            for p, verdict in self.by_host.get(domain, ()):
                if path.startswith(p) and (best is None or len(domain) + len(p) > len(best[0])):
                    best = domain + p, verdict
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best


_STEPS = np.random.default_rng(20_240_905).integers(1, 1 << 63, (2, max(GRAMS)), dtype=np.uint64) | np.uint64(1)


def grams(hosts: list[str], paths: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(url, bucket) of the distinct buckets of each url's character n-grams, host and path apart, each between ``^`` and ``$``."""
    found = []
    for steps, texts in zip(_STEPS, (hosts, paths)):
        marked = [f"^{t}$" for t in texts]
        chars = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        of = np.repeat(np.arange(len(marked)), [len(t) for t in marked])
        for n in GRAMS:
            if len(chars) < n:
                continue
            h = np.zeros(len(chars) - n + 1, dtype=np.uint64)
            for i in range(n):
                h += mixed(chars[i : len(chars) - n + 1 + i]) * steps[i]
            own = of[: len(h)] == of[n - 1 :]
            found.append(of[: len(h)][own] * buckets + (mixed(h[own] + np.uint64(n)) % np.uint64(buckets)).astype(np.int64))
    every = np.unique(np.concatenate([np.empty(0, np.int64), *found]))
    return every // buckets, every % buckets


class UrlModel:
    """Logistic regression, one weight for each bucket; full-batch gradient descent with an L2 penalty."""

    def __init__(self, labelled=None, steps: int = 400, rate: float = 2.0, decay: float = 1e-3, buckets: int = BUCKETS):
        labelled = LABELLED if labelled is None else labelled
        self.buckets, self.w, self.b = buckets, np.zeros(buckets), 0.0
        y, n = np.array([t for _, t in labelled], dtype=float), len(labelled)
        row, index = grams(*zip(*(split_url(u) for u, _ in labelled)), buckets)
        norm = np.sqrt(np.maximum(1, np.bincount(row, minlength=n)))
        for _ in range(steps):
            z = np.bincount(row, weights=self.w[index], minlength=n) / norm + self.b
            g = (1 / (1 + np.exp(-z)) - y) / n
            self.w -= rate * (np.bincount(index, weights=(g / norm)[row], minlength=buckets) + decay * self.w)
            self.b -= rate * g.sum()

    def scores(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """How likely each url is unwanted, to 12 decimals: the same wherever it stands."""
        row, index = grams(hosts, paths, self.buckets)
        norm = np.sqrt(np.maximum(1, np.bincount(row, minlength=len(hosts))))
        return np.round(1 / (1 + np.exp(-(np.bincount(row, weights=self.w[index], minlength=len(hosts)) / norm + self.b))), 12)


def judge(pages: DataFrame, rules=RULES, labelled=None, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; the score is null where a rule decides."""
    model, table = UrlModel(labelled), Rules(rules)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, URLS):
                page_ids, urls = (batch.column(c).slice(at, URLS).to_pylist() for c in (0, 1))
                hosts, paths = zip(*map(split_url, urls))
                ruled = [table.longest(h, p) or (None, None) for h, p in zip(hosts, paths)]
                scores = model.scores(hosts, paths)
                verdicts = [v or ("block" if p >= threshold else "allow") for (_, v), p in zip(ruled, scores)]
                columns = (page_ids, hosts, paths, [r for r, _ in ruled], verdicts, [None if v else p for (_, v), p in zip(ruled, scores.tolist())])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), *[pa.string()] * 4, pa.float64()))], names=["page_id", "host", "path", "rule", "verdict", "score"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).mapInArrow(run, "page_id long, host string, path string, rule string, verdict string, score double")
