"""URL filters: host names are split into words by a unigram Viterbi search, and multinomial naive Bayes scores the
words of host and path; explicit rules go first.

Unigrams: the whole words of a public tokenizer's vocabulary (a parameter; some 25,000, read by the driver), whose ranks
follow their frequency: rank r gets a share in proportion to 1 / (r + 2.7), after Zipf; words of the topics below that the
file lacks get the share of `TOPIC_RANK`. Letters that no word covers cost more the more there are.

Classifier: multinomial and Laplace-smoothed, with weights of their own for words of hosts and of paths, from the shares of made
names: each topic counts alike, and in a name a topic's word meets another of its words or, as often, a word that any name may have (`CONNECTORS`: as
frequent in both classes, so they say nothing). Words of topics to block that other names have too (`AMBIGUOUS`) are a topic of the other class as well, so one of
them alone doesn't block. A path says less than a host: pages of any site write of anything, so `ELSEWHERE` of a path's words are the other class's topics,
and one word of a path never blocks. Words in no topic say nothing. The topics are what such filters are about (gambling, adult, pills, adverts, piracy,
spam, scams); they were written without the tables.

A page's result depends on its own URL alone: nothing moves between pages, so no hot host or word gathers anywhere. Both
models have a fixed size (`MAX_WORDS`, checked) and are broadcast. A task splits a host's parts once for each batch of rows.

Defined cases: a null URL or one without `://` has an empty host and path, no rule and the verdict of the prior
(allow); of rules that fit, the longest wins (block before allow if one text is given twice); hosts and paths of any length are
read whole; repeated rows each get their result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import math
import re
from collections import Counter
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (verdict, host and path prefix).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MAX_WORDS, TOPIC_RANK, LONGEST = 200_000, 20_000, 24
#: Share of pages to block, before anything is known of one.
PRIOR = 0.1

#: Words of the topics to block.
BLOCK_TOPICS = {
    "gambling": "casino casinos poker bet bets betting bettor gamble gambling gambler slots slot jackpot roulette blackjack baccarat craps bingo lottery lotto keno wager wagers wagering bookmaker bookie bookies sportsbook odds punter vegas dice croupier spins payout highroller bankroll tipster parlay handicap",
    "adult": "porn porno pornstar sex sexy sexual xxx adult nude nudes naked erotic erotica escort escorts milf hentai fetish camgirl camgirls webcam cams stripper strip topless bdsm lesbian boobs ass pussy dick cock anal blowjob orgy horny slut sluts hooker hookers whore swinger swingers hookup hookups lust kinky teens hardcore softcore amateur voyeur videos tube",
    "pills": "viagra cialis levitra pill pills meds pharmacy pharma prescription tramadol xanax valium ambien oxycodone adderall phentermine steroids steroid hgh testosterone enhancement erectile slimming detox keto cbd weightloss dietpills painkiller painkillers opioid antidepressant rx drugstore potency enlargement",
    "adverts": "ad ads adserver adserve adclick adtrack advert adverts advertising adnetwork track tracker trackers tracking click clicks clicker pixel beacon beacons banner banners popup popunder impression impressions affiliate affiliates syndication retarget retargeting telemetry adsense adware sponsored",
    "piracy": "torrent torrents warez crack cracks cracked keygen serial serials nulled pirate pirated piracy bittorrent magnet leech leecher seedbox camrip dvdrip bluray putlocker rip ripped patcher activator",
    "spam": "spam spammer spammy bulkmail backlink backlinks linkfarm farm farms doorway autoblog cloaking spin spinner clickbait traffic followers likes botnet bot bots autopost massmail junkmail referrer",
    "scams": "scam scams phish phishing malware virus trojan ransomware keylogger hack hacks hacker hacked cheat cheats giveaway prize winner winners sweepstakes payday loan loans debt lender cashadvance forex binary options bitcoin crypto doubler ponzi pyramid mlm getrich quickcash millionaire inheritance prince verify refund claim unclaimed",
    "replicas": "replica replicas rolex knockoff counterfeit fake fakes outlet cheap wholesale handbags gucci vuitton watches oakley discount clearance passport diploma certificates essays essay",
}
#: Words of other topics.
ALLOW_TOPICS = {
    "news": "news daily times post herald tribune gazette journal press reporter report reports weather radio tv television broadcast magazine editorial headline headlines chronicle observer guardian bulletin media podcast interview politics opinion",
    "learning": "school schools college university academy campus student students teacher teachers lesson lessons course courses learn learning education educational tutor kindergarten alumni faculty scholar curriculum homework exam library libraries dictionary grammar language languages linguistics wiki encyclopedia wikipedia reference",
    "science": "science scientific research lab labs laboratory physics chemistry biology genome astronomy space telescope geology climate ecology mathematics math statistics theory engineering engineer robotics quantum institute nature ocean fossil evolution neuron",
    "code": "code coding developer developers software program programming python java linux github api docs documentation tutorial database server cloud data compiler algorithm kernel debug stack framework repository open source hosting computing",
    "health": "health healthy hospital hospitals clinic clinics doctor doctors nurse nursing dental dentist medical medicine patient patients therapy surgery cancer heart pediatric vaccine wellness yoga fitness nutrition mental care veterinary emergency",
    "food": "recipe recipes kitchen cook cooking bake baking bakery bread food foods restaurant restaurants cafe coffee tea wine beer cheese vegan vegetable garden gardening chef dinner lunch breakfast pizza sushi grill soup farm farms farmer farmers harvest orchard",
    "travel": "travel traveler trip trips tour tours tourism hotel hotels hostel flight flights airline airport railway train trains bus metro map maps guide guides island beach mountain hiking camping cruise museum castle city village visit visitor adventure backpack",
    "arts": "art arts artist artists gallery museum music musician band orchestra concert guitar piano song songs lyrics film films movie movies cinema theatre theater dance ballet opera poetry poem novel novels book books author literature photo photos photography paint painting sculpture design designer studio comic comics",
    "sports": "sport sports football soccer basketball baseball hockey tennis golf rugby cricket swim swimming running marathon cycling bike bikes ski skiing athletics athlete stadium league team teams coach olympic chess climbing rowing surf",
    "business": "business company companies corporate office industry industrial factory manufacturing logistics consulting consultant accounting finance financial bank banking insurance invest investor market markets trade commerce economy jobs job career careers hiring employer union retail store supply",
    "civic": "government council county state federal ministry parliament senate mayor court courts law laws legal lawyer attorney police fire rescue army veterans tax census election vote citizen citizens community charity foundation volunteer church parish temple mosque bible faith embassy",
    "home": "home homes house houses garden furniture kitchen bathroom roof roofing plumbing electric electrician carpenter carpentry wood paint tools hardware lamp floor window windows interior decor architect architecture property realty estate rent rental apartment moving cleaning",
    "people": "family families parent parents baby babies kids children child mother father wedding birthday grandparents genealogy ancestry friends friend social forum forums chat blog blogs diary profile dating mail message letters group groups club clubs",
    "things": "car cars auto motor truck motorcycle boat aviation aircraft phone phones mobile computer computers laptop camera cameras audio electronics battery solar energy power gas oil water toy toys game games puzzle lego craft crafts knitting sewing quilt jewelry shoes fashion clothing clothes",
    "nature": "animal animals pet pets dog dogs cat cats horse horses bird birds fish wildlife zoo forest tree trees river lake sea flower flowers plant plants bee bees insect park parks rain snow storm earth environment recycle conservation",
    "history": "history historic historical heritage archive archives ancient medieval roman egypt war wars museum antique antiques memorial century dynasty archaeology monument treaty revolution empire civil manuscript map",
}
#: Words of the topics to block that other names have as well.
AMBIGUOUS = (
    "track tracking hacker hackers hack hacks passport passports serial prize claim claims refund refunds verify teens amateur amateurs watches outlet wholesale discount certificates fake bot bots spin spinner dice vegas prescription pixel "
    "beacon beacons banner banners magnet debt handbags diploma essay essays impression impressions webcam strip rip binary options prince pyramid inheritance detox clearance telemetry"
)
#: Words of each class that the smoothing takes the shares to come from, and the share of a path's words that are the other class's.
NAMES, ELSEWHERE = 20_000, 0.2
#: Words that names of any kind have.
CONNECTORS = "online web net site sites hub zone world best top my the get free now pro plus shop store live direct express center group info portal page pages today first all new big one easy fast super smart global international local american euro uk us usa asia king city box spot land point line base link links network digital media united national central star gold blue red green black white win play buy sell deal deals day night time life love home house club team master max go up app".split()
#: Two letters that are words; others of the vocabulary are parts of words.
SHORT = "of to in it is be as at so we he by on or do if me my up an go no us am tv uk".split()

_HOST = r"^.*?://([^/?#]*)"
_PATH = r"^.*?://[^/?#]*([^?#]*)"
_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_RUN = re.compile(r"[a-z]+")


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + _HOST, 1), *_ASCII)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)" + _PATH, 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict), or null. The rules are a parameter, few by nature."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block")):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def word_shares(topics: Iterable[str], connectors: Sequence[str] = CONNECTORS) -> dict[str, float]:
    """Share of each word among the words of a class's names. Topics count alike; of a topic's names half are two of its words, half one of them and a connector."""
    found: Counter[str] = Counter()
    topics = [list(dict.fromkeys(t.split())) for t in topics]
    for own in topics:
        for w in own:
            found[w] += 0.75 / len(own) / len(topics)
    for c in connectors:
        found[c] += 0.25 / len(connectors)
    return dict(found)


def naive_bayes(block: dict[str, str] | None = None, allow: dict[str, str] | None = None) -> tuple[dict[str, float], dict[str, float]]:
    """Word to log P(word | block) - log P(word | allow), Laplace-smoothed as from NAMES words of each class: for hosts, and for paths."""
    b, a = word_shares((block or BLOCK_TOPICS).values()), word_shares([*(allow or ALLOW_TOPICS).values(), AMBIGUOUS])
    words = sorted(b | a)
    ratio = lambda x, y: math.log((x * NAMES + 1) / (y * NAMES + 1))
    other = lambda x, y: (1 - ELSEWHERE) * x + ELSEWHERE * y
    both = [(w, b.get(w, 0.0), a.get(w, 0.0)) for w in words]
    return {w: ratio(x, y) for w, x, y in both}, {w: ratio(other(x, y), other(y, x)) for w, x, y in both}


def unigrams(path: str = VOCABULARY, max_words: int = MAX_WORDS) -> dict[str, float]:
    """Word to log share: whole words of a vocabulary file of lines `base64 rank`, and those of the topics."""
    ranks: dict[str, int] = {w: k for k, w in enumerate(SHORT)}
    with open(path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            word = base64.b64decode(token).lower()
            if word[:1] == b" " and len(word) > 3 and word[1:].isalpha() and word.isascii():
                ranks.setdefault(word[1:].decode(), int(rank))
    for topic in (*BLOCK_TOPICS.values(), *ALLOW_TOPICS.values(), AMBIGUOUS, " ".join(CONNECTORS)):
        for w in topic.split():
            if len(w) > 2 or w in SHORT or w == "ad":
                ranks[w] = min(ranks.get(w, TOPIC_RANK), TOPIC_RANK)
    if len(ranks) > max_words:
        raise ValueError(f"{len(ranks)} words are more than max_words ({max_words})")
    total = sum(1 / (r + 2.7) for r in ranks.values())
    return {w: -math.log((r + 2.7) * total) for w, r in ranks.items()}


def unknown(n: int) -> float:
    """Log share of n letters that are no word: below that of any word of that length."""
    return -13.0 - 2.5 * n


def split_name(name: str, shares: dict[str, float], longest: int = LONGEST) -> list[str]:
    """The most likely words of a name; of equally likely ones the longest last word. A piece without a word is `longest` letters at most."""
    best = [0.0] + [-math.inf] * len(name)
    back = [0] * (len(name) + 1)
    for j in range(1, len(name) + 1):
        for i in range(max(0, j - longest), j):
            score = best[i] + shares.get(name[i:j], unknown(j - i))
            if score > best[j]:
                best[j], back[j] = score, i
    words, j = [], len(name)
    while j:
        words.append(name[back[j] : j])
        j = back[j]
    return words[::-1]


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, vocabulary: str = VOCABULARY) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, words (of the host), score (log odds; above 0 is to be blocked)."""
    shared = pages.sparkSession.sparkContext.broadcast((unigrams(vocabulary), naive_bayes()))
    prior = math.log(PRIOR / (1 - PRIOR))

    def run(batches):
        shares, (of_host, of_path) = shared.value
        for batch in batches:
            known: dict[str, list[str]] = {}
            hosts: dict[str, tuple[list[str], float]] = {}
            words, scores = [], []
            for host, path in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if host not in hosts:
                    found = []
                    for part in _RUN.findall(host):
                        if part not in known:
                            known[part] = split_name(part, shares)
                        found += known[part]
                    hosts[host] = found, sum(of_host.get(w, 0.0) for w in found)
                found, score = hosts[host]
                words.append(found)
                scores.append(prior + score + sum(of_path.get(w, 0.0) for w in _RUN.findall(path.lower())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.list_(pa.string())), pa.array(scores, pa.float64())], [*batch.schema.names, "words", "score"])

    urls = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    kind = pages.schema["page_id"].dataType.simpleString()
    found = urls.mapInArrow(run, f"page_id {kind}, host string, path string, words array<string>, score double").withColumn("r", rule_of(F.col("host"), F.col("path"), rules))
    return found.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), "words", "score")


def brute_rule(url: str | None, rules: Sequence[tuple[str, str]] = RULES) -> tuple[str, str, str | None, str | None]:
    """Host, path and rule by plain string work, for tests."""
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in rules if (host == (n := r.split("/", 1)[0]) or host.endswith("." + n)) and path.startswith(r[len(n) :])]
    return (host, path, *(max(fits)[1:] if fits else (None, None)))
