"""Personal data by bootstrapped contextual extraction: seed entities induce lexical patterns, a graph of patterns and
instances is scored in rounds, and patterns of high confidence discover identifiers that no seed form covers.

Seeds are the spans of four fixed forms (email, ip, card, phone; see `base`). An instance is a string that looks like an
identifier: a seed, or one of the loose forms of `candidates` (a number with separators, an address with the signs spelled out).
Its patterns are the words around it: two to the left, one on each side, one to the left. The graph has an edge for each distinct
(pattern, instance), however often the corpus repeats it, so copies of a document add nothing.

A round scores patterns and then instances. For a kind, a pattern's confidence is the sum of its instances' scores over their
number plus one, all identifier-like strings counted, so a word that any number may follow scores low; it counts from
`support` in scores and `confidence` on. An instance that is no seed has 1 - prod(1 - confidence) over the patterns it stands in.
After `rounds` rounds, or where a round changes no pattern, a candidate is a span of the kind whose patterns, where it stands, give at least `accept`.

Texts are read once, in one pass of whole rows; what travels after that are candidates and their few words, not texts. The joins
on patterns and on instances are salted, sums are partial before a shuffle, and the passes are cut by checkpoint(). Work on a text is linear in
its length but for what a regular expression may look at twice.

Defined cases: null and empty texts have no spans; repeated rows each get their result, and rows of one id are judged by themselves;
a null doc_id stays; extra columns are ignored; an empty table gives an empty result; candidates that touch a seed are dropped;
where a candidate is accepted for two kinds, the higher score counts, then the kind listed first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import use_shared_checkpoints

KINDS = ("email", "ip", "card", "phone")
SUPPORT, CONFIDENCE, ACCEPT, ROUNDS, SALT = 4.0, 0.8, 0.8, 3, 16
#: Letters of a context word that count; longer ones are cut.
WORD_CHARS = 24

# The forms of the seeds. The domain is searched from the @ on, and the name before it is what precedes.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NAME_END = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose forms: an address with its signs spelled out or without a dot, and numbers with other separators or none before them.
_AT, _DOT = r"(?:@|[\[({<]\s?at\s?[\])}>]| at )", r"(?:\.|[\[({<]\s?dot\s?[\])}>]| dot )"
_LOOSE_MAIL = re.compile(rf"(?<![\w.%+-])[\w.%+-]{{1,64}}\s?{_AT}\s?[A-Za-z0-9-]{{1,64}}(?:\s?{_DOT}\s?[A-Za-z0-9-]{{2,64}}){{0,5}}", re.ASCII)
_SIGN = re.compile(r"@|[\[({<]\s?(?:at|dot)\s?[\])}>]| at | dot ")
_LOOSE_NUMBER = re.compile(r"(?<![\w.])\(?[0-9](?:(?:[\x20\xA0()./_:‐-–-]|\[\.\]){0,2}[0-9])++(?!\w)")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"\S+")


def luhn(digits: str) -> bool:
    """The checksum of card numbers: every second digit from the right doubled."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    found, after = [], 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        lo = start
        while lo > after:  # the name's characters, some at a time
            step = max(after, lo - 64)
            name = _NAME_END.search(text, step, lo)
            begin = name.start() if name else lo
            lo, more = begin, begin == step
            if not more:
                break
        if lo < start:
            found.append((lo, m.end()))
            after = m.end()
    return found


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the seeds, in order."""
    out = [(s, 0, e) for s, e in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start():
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return sorted(out)


def _plain(word: str) -> str:
    """A context word: lower case, digits as 0, cut; its signs stay."""
    return _DIGIT.sub("0", word[-WORD_CHARS:].lower())


def _before(text: str, at: int, n: int = 2) -> list[str]:
    return text[max(0, at - 4 * WORD_CHARS) : at].split()[-n:]


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a span: its kind of context, and the words."""
    left = [_plain(w) for w in _before(text, start)]
    m = _WORD.search(text, end, end + 4 * WORD_CHARS)
    right = _DIGIT.sub("0", m[0][:WORD_CHARS].lower()) if m else ""
    if not left:
        return []
    out = [f"1|{left[-1]}"]
    if len(left) == 2:
        out.append(f"2|{left[0]} {left[1]}")
    if right:
        out.append(f"3|{left[-1]}|{right}")
    return out


def candidates(text: str, seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[int], str]]:
    """(start, end, seed kind or -1, kinds that it may be, value) of all instances: the seeds, and loose forms that touch none of them."""
    out = [(s, e, k, [k], _value(text[s:e], k)) for s, k, e in seeds]
    taken = sorted((s, e) for s, _, e in seeds)
    loose = []
    if _SIGN.search(text):
        loose += [(m.start(), m.end(), [0]) for m in _LOOSE_MAIL.finditer(text) if len(_SIGN.findall(m[0])) > 1 or "@" in m[0]]
    if _DIGIT.search(text):
        for m in _LOOSE_NUMBER.finditer(text):
            n = len(_DIGIT.findall(m[0])) if m.end() - m.start() < 64 else 99
            parts = [p for p in re.split(r"[^0-9]+", m[0]) if p] if n <= 19 else []
            kinds = [1] * (len(parts) == 4 and all(len(p) <= 3 for p in parts)) + [2] * (12 <= n <= 19) + [3] * (7 <= n <= 15)
            if n >= 4 and n < 64:
                loose.append((m.start(), m.end(), kinds))
    i = 0
    ends = 0
    for s, e, kinds in sorted(loose):
        while i < len(taken) and taken[i][0] < s:
            ends = max(ends, taken[i][1])
            i += 1
        if ends > s or i < len(taken) and taken[i][0] < e:
            continue
        out.append((s, e, -1, kinds, _value(text[s:e], kinds[0] if kinds else 1)))
    return out


def _value(found: str, kind: int) -> str:
    return re.sub(r"\s+", " ", found.lower()) if kind == 0 else re.sub(r"[^0-9]+", "-", found).strip("-")


SPAN = "struct<start:bigint,kind:int,end:bigint>"
SCHEMA = f"row long, doc_id {{kind}}, base array<{SPAN}>, candidates array<struct<start:bigint,end:bigint,seed:int,kinds:int,value:string,contexts:array<string>>>"


def scan(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: row (a number of its own), the id, the seeds, and all instances with their patterns."""

    def run(batches):
        for batch in batches:
            rows = []
            for row, doc, text in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "text")), strict=True):
                text = text or ""
                seeds = base(text)
                found = [{"start": s, "end": e, "seed": k, "kinds": sum(1 << k for k in kinds), "value": v, "contexts": contexts(text, s, e)} for s, e, k, kinds, v in candidates(text, seeds)]
                rows.append({"row": row, "doc_id": doc, "base": [{"start": s, "kind": k, "end": e} for s, k, e in seeds], "candidates": found})
            yield pa.RecordBatch.from_pylist(rows, schema=shape)

    kind = docs.schema[id_col].dataType.simpleString()
    span = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
    instance = [("start", pa.int64()), ("end", pa.int64()), ("seed", pa.int32()), ("kinds", pa.int32()), ("value", pa.string()), ("contexts", pa.list_(pa.string()))]
    shape = pa.schema([("row", pa.int64()), ("doc_id", {"bigint": pa.int64(), "int": pa.int32()}.get(kind, pa.string())), ("base", pa.list_(pa.struct(span))), ("candidates", pa.list_(pa.struct(instance)))])
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), "text").mapInArrow(run, SCHEMA.format(kind=kind))


def _salted(left: DataFrame, right: DataFrame, key: str, by: str) -> DataFrame:
    """An equi-join in which a key's left rows are dealt to SALT tasks by another column, and its right rows are sent to each."""
    many = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return left.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int")).join(many, [key, "_salt"]).drop("_salt")


def _may_be() -> Column:
    """Whether kinds, a bit for each, has the kind."""
    return F.expr("shiftright(kinds, kind) % 2 = 1")


def _either(confidence: Column) -> Column:
    """1 - prod(1 - c) over a group."""
    return 1 - F.exp(F.sum(F.log(F.greatest(1 - confidence, F.lit(1e-9)))))


def patterns(instances: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(context, kind, confidence) of the patterns that count after the last round. instances: value, seed, kinds, contexts; a row each occurrence."""
    edges = instances.select("value", "seed", "kinds", F.explode("contexts").alias("context")).groupBy("context", "value").agg(F.max("seed").alias("seed"), F.bit_or("kinds").alias("kinds")).checkpoint()
    seeds = edges.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0)).checkpoint()
    sizes = edges.groupBy("context").agg(F.count("*").alias("of"))
    scores = seeds
    before, found = None, None
    for k in range(rounds):
        sums = _salted(edges.select("context", "value"), scores, "value", "context").groupBy("context", "kind").agg(F.sum("score").alias("sum")).where(F.col("sum") >= support)
        found = sums.join(sizes, "context").select("context", "kind", (F.col("sum") / (F.col("of") + 1)).alias("confidence")).where(F.col("confidence") >= confidence).checkpoint()
        now = found.agg(F.count("*"), F.sum("confidence")).first()
        if not now[0] or now == before:
            return found  # nothing speaks of anything new
        before = now
        if k + 1 < rounds:
            open_ = edges.where("seed < 0").select("context", "value", "kinds")
            more = _salted(open_, found, "context", "value").where(_may_be()).groupBy("value", "kind").agg(_either(F.col("confidence")).alias("score"))
            scores = seeds.union(more.join(seeds.select("value", "kind"), ["value", "kind"], "left_anti")).checkpoint()
    return found


def find(docs: DataFrame, id_col: str = "doc_id", accept: float = ACCEPT, **graph) -> DataFrame:
    """Per row: the id, base (the seeds' spans) and added (those that patterns discovered), arrays of (start, kind, end), kind a place in KINDS."""
    use_shared_checkpoints(docs.sparkSession)
    scanned = scan(docs, id_col).checkpoint()
    each = scanned.select("row", F.explode("candidates").alias("c")).select("row", "c.*")
    known = patterns(each, **graph)
    if not known.take(1):
        return scanned.select(F.col("doc_id").alias(id_col), "base", F.array().cast(f"array<{SPAN}>").alias("added"))
    open_ = each.where("seed < 0 and kinds > 0").select("row", "start", "end", "kinds", F.explode("contexts").alias("context"))
    scored = _salted(open_, known, "context", "row").where(_may_be()).groupBy("row", "start", "end", "kind").agg(_either(F.col("confidence")).alias("score")).where(F.col("score") >= accept)
    best = scored.groupBy("row", "start", "end").agg(F.min_by("kind", F.struct((-F.col("score")).alias("s"), "kind")).alias("kind"))
    added = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("added"))  # at most a text's candidates
    none = F.array().cast(f"array<{SPAN}>")
    return scanned.select("row", "doc_id", "base").join(added, "row", "left").select(F.col("doc_id").alias(id_col), "base", F.coalesce("added", none).alias("added"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base spans, their hash, and all spans."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))
