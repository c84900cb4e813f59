"""URL filter: allow and block rules by host and path, else a weighted vocabulary found by Aho-Corasick.

The automaton holds all terms; one pass over the lower-cased url reports every occurrence. An occurrence counts
when no ASCII letter or digit stands right before or after it. One strict term, or `least_soft` distinct soft
terms, block a url. The score is the sum of the weights of the distinct terms found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
# A strict term decides alone. A soft one has everyday senses as well and needs a second beside it; everyday words with
# two forms are listed in one form, so that a page does not count one word twice.
STRICT = tuple(
    """
    porn porno pornos porns porntube pornhub pornstar pornstars pornographic xxx xxxtube sex sexo sexe sexy sexcam sexcams sexchat
    sexshop sexvideo sexvideos sextape sextapes sextube sextoy sextoys nude nudes nsfw adult adults hentai milf milfs camgirl
    camgirls upskirt blowjob blowjobs handjob handjobs gangbang gangbangs bukkake creampie cumshot cumshots deepthroat bdsm erotic
    erotica erotik erotique erotico softcore threesome threesomes orgy orgies dildo dildos striptease stripclub stripclubs escort
    escorts callgirl callgirls call-girl call-girls onlyfans swingers xvideos xnxx xhamster redtube youporn brazzers
    casino casinos kasino kasinos poker pokerstars pokies blackjack baccarat sportsbook sportsbooks bookie bookies freespins
    free-spins slot-machine slot-machines slotmachine slotmachines
    viagra cialis levitra kamagra sildenafil tadalafil vardenafil phentermine online-pharmacy onlinepharmacy canadian-pharmacy
    no-prescription penis-enlargement
    warez torrent torrents keygen keygens piratebay thepiratebay rapidgator
    malware phishing ransomware spyware keylogger keyloggers botnet botnets
    spam-farm spam-farms spamfarm spamfarms link-farm link-farms linkfarm linkfarms buy-backlinks buy-followers payday-loan
    payday-loans paydayloan paydayloans essay-mill essay-mills
    """.split()
)
SOFT = tuple(
    """
    ad ads adserver affiliate affiliates banner banners popunder sponsored bet bets betting bettor bettors wager wagers gamble
    gambling gambler gamblers roulette jackpot jackpots lotto lottery lotteries bingo slots bonus bonuses buy cheap cheapest click
    clickbait coupon coupons deal deals discount discounts dating singles flirt download free freebie freebies giveaway giveaways
    loan loans payday pill pills meds pharmacy tramadol valium xanax ambien weightloss enlargement promo promos spam spammer
    spammers track tracker trackers tracking win prize prizes forex replica replicas crack cracks cracked serials nulled backlinks
    unlimited guaranteed naked nudity stripper strippers fetish webcam
    """.split()
)
STRICT_WEIGHT = 1.0
SOFT_WEIGHT = 0.5
LEAST_SOFT = 2
PARTS = r"^(?s).*?://([^/?#]*)([^?#]*)"
_EDGE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_OUT = "rule string, verdict string, score double, strict array<string>, soft array<string>"


@cache
def _automaton(strict: tuple, soft: tuple) -> ahocorasick.Automaton:
    terms = ahocorasick.Automaton()
    for term in soft:
        terms.add_word(term, (term, False))
    for term in strict:
        terms.add_word(term, (term, True))
    terms.make_automaton()
    return terms


def hits(url: str, strict: tuple = STRICT, soft: tuple = SOFT) -> tuple[list[str], list[str]]:
    """Distinct strict and soft terms of a url, sorted."""
    url = url.translate(_LOWER)
    found: tuple[set, set] = set(), set()
    for end, (term, is_strict) in _automaton(strict, soft).iter(url):
        start = end + 1 - len(term)
        if (start == 0 or url[start - 1] not in _EDGE) and (end + 1 == len(url) or url[end + 1] not in _EDGE):
            found[0 if is_strict else 1].add(term)
    return sorted(found[0]), sorted(found[1])


def match_rule(host: str, path: str, rules: dict[str, list[tuple[str, str]]]) -> tuple[str, str] | None:
    """The longest rule, written host and path, that fits; of equally long ones that with the longer host."""
    best = None
    parent = host
    while True:
        for prefix, verdict in rules.get(parent, ()):
            if path.startswith(prefix) and (best is None or len(parent) + len(prefix) > len(best[0])):
                best = parent + prefix, verdict
        _, dot, parent = parent.partition(".")
        if not dot:
            return best


def _judge(rules: tuple, strict: tuple, soft: tuple, least_soft: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in rules:
            by_host.setdefault(host, []).append((path, verdict))
        for batch in batches:
            rows = []
            for url, host, path in zip(*(batch.column(c).to_pylist() for c in ("_url", "host", "path")), strict=True):
                rule = match_rule(host, path, by_host)
                hard, weak = hits(url or "", strict, soft)
                blocked = bool(hard) or len(weak) >= least_soft
                verdict = rule[1] if rule else "block" if blocked else "allow"
                rows.append((rule and rule[0], verdict, STRICT_WEIGHT * len(hard) + SOFT_WEIGHT * len(weak), hard, weak))
            names = ["rule", "verdict", "score", "strict", "soft"]
            kinds = [pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
            new = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            kept = [c for c in batch.schema.names if c != "_url"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *names])

    return run


def judge(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", rules: tuple = RULES, strict: tuple = STRICT, soft: tuple = SOFT, least_soft: int = LEAST_SOFT) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, score and the terms found.

    A null url, or one without `://`, has empty host and path and fits no rule; a null url has no terms and is
    allowed. Repeated rows stay. Other columns are not read.
    """
    url = F.coalesce(F.col(url_column), F.lit(""))
    rows = pages.select(
        F.col(id_column),
        F.col(url_column).alias("_url"),
        F.translate(F.regexp_extract(url, PARTS, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("host"),
        F.regexp_extract(url, PARTS, 2).alias("path"),
    )
    kind = dict(rows.dtypes)[id_column]
    return rows.mapInArrow(_judge(rules, strict, soft, least_soft), f"`{id_column}` {kind}, host string, path string, {_OUT}")
