"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a span classifier decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import let, table
from skein.plans.storage import save

#: The base kinds, then those that only the method finds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban", "ssn")
EMAIL, IP, CARD, PHONE, SECRET, IBAN, SSN = range(7)
BASE_KINDS = KINDS[:4]
LABELERS = ("shape", "gazetteer", "context", "neighbours", "form")
#: Votes: abstain, no, yes.
VOTES, NO, YES = 3, 1, 2
PATTERNS = VOTES ** len(LABELERS)
#: Probability from which a span that the base rules miss is added.
ACCEPT = 0.5

# The base expressions.  They find the contract's leftmost matches; the quantifiers are possessive and a
# run of local-part characters or digits is entered at its start (or after the last match) only, which gives the same
# matches in time linear in the text.
BASE = {
    EMAIL: r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}+",
    CARD: r"[0-9](?:[\x20-]?[0-9])++",
    PHONE: r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Looser expressions for candidates that the base rules miss.  An obfuscated address has a local part of at most
#: 64 characters and at most 9 labels of at most 63, as real ones do.
LOOSE = {
    EMAIL: r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}\s?[(\[{]\s?at\s?[)\]}]\s?[a-z0-9-]{1,63}(?:\s?(?:[(\[{]\s?dot\s?[)\]}]|\.)\s?[a-z0-9-]{1,63}){1,8}",
    IP: r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    PHONE: r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    SECRET: r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[0-9+/_-]*+[A-Za-z])[A-Za-z0-9+/_-]{20,}+",
    IBAN: r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    SSN: r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
}
#: A text without a match of these has no candidate of the kind.
GUARD = {EMAIL: r"@|(?i:[(\[{]\s?at\s?[)\]}])", IP: r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", CARD: r"[0-9][\x20-]?[0-9]", PHONE: r"\+[0-9]|[0-9]\)?[ .-][0-9]{3}[ .-][0-9]{4}", SECRET: r"[A-Za-z0-9+/_-]{20}", IBAN: r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", SSN: r"[0-9]-[0-9]{2}-[0-9]{4}"}
#: Gazetteers and cue words.
TOP_DOMAINS = "com org net edu gov info biz io de fr es uk eu it nl ch at be pl us ca au jp cn in br ru se no dk fi pt ie example test"
IBAN_COUNTRIES = "AD AE AL AT AZ BA BE BG BH BR BY CH CR CY CZ DE DK DO EE EG ES FI FO FR GB GE GI GL GR GT HR HU IE IL IQ IS IT JO KW KZ LB LC LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SC SE SI SK SM ST SV TL TN TR UA VA VG XK"
COUNTRY_CODES = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
CARD_PREFIXES = r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6011|65|62)"
CUES = {EMAIL: "mail|contact|write|courriel|correo|kontakt|@", IP: r"\bip\b|addr|host|server|login|from", CARD: "card|visa|master|credit|pay|karte|carte|tarjeta", PHONE: "phone|call|tel|mobile|fax|contact|ruf|móvil|numéro", SECRET: r"[:=]\s*[\"']?$", IBAN: "iban|account|konto|compte|cuenta|bank|bic", SSN: r"ssn|social|security|\btax|\bid\b"}
#: Names that a secret is assigned to, prefixes that issuers give to keys, and what stands before digests that are no secrets.
SECRET_NAMES = r"(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth(?:orization)?|bearer|credentials?|private[_-]?key)[\"']?\s*[:=]?\s*[\"']?$"
SECRET_PREFIXES = r"^(?:AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|glpat-|sk-|sk_live_|rk_live_|xox[abprs]-|AIza|ya29|eyJ|npm_|hf_)"
DIGEST_NAMES = r"(?:commit|sha-?[0-9]*|hash|checksum|md5|digest|integrity|revision|etag|https?)[^\p{L}0-9]{0,3}$"
ANTI_CUES = r"(?:version|release|isbn|order|invoice|serial|sku|hash|commit|token|sha|id)[^\p{L}0-9]{0,3}$"


def _sums(values: Column, block: int = 64) -> Column:
    """Running sums of an array of longs, in blocks, so that the work stays near linear in its length."""
    add = lambda a, b: a + b
    zero = F.lit(0).cast("long")

    def run(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")), lambda k: F.aggregate(F.slice(v, k * block + 1, block), zero, add))
        before = lambda b: F.transform(b, lambda _, k: F.aggregate(F.slice(b, 1, k), zero, add))
        inner = lambda o: F.transform(v, lambda _, i: F.get(o, F.floor(i / block).cast("int")) + F.aggregate(F.slice(v, F.floor(i / block).cast("int") * block + 1, i % block + 1), zero, add))
        return let(let(blocks, before), inner)

    return F.when(F.size(values) > 0, let(values, run)).otherwise(F.array().cast("array<bigint>"))


def matches(text: Column, pattern: str) -> Column:
    """All matches as structs: ``s``, ``e`` (code points, end exclusive), ``m``, and up to 40 characters left, 1 right."""

    def place(x: Column) -> Column:
        steps = F.transform(x["m"], lambda m, i: (F.length(F.get(x["p"], i)) + F.length(m)).cast("long"))
        at = lambda ends: F.transform(x["m"], lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("s"), F.get(ends, i).alias("e"), m.alias("m"), F.right(F.get(x["p"], i), F.lit(40)).alias("l"), F.left(F.get(x["p"], i + 1), F.lit(1)).alias("r")))
        return let(_sums(steps), at)

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p")), place)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether at most 19 ``digits`` pass the Luhn test."""
    value = lambda i: F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
    step = lambda s, i: s + F.when(i % 2 == 0, value(i)).when(value(i) > 4, 2 * value(i) - 9).otherwise(2 * value(i))
    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _valid(kind: int, m: Column) -> Column:
    """The base rule's test of a match."""
    if kind == EMAIL:
        return F.lit(True)
    if kind == IP:
        return F.forall(F.split(m, r"\."), lambda p: let(F.ltrim(p, F.lit("0")), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))
    return let(_digits(m), lambda d: F.length(d).between(14, 19) & luhn(F.left(d, F.lit(19))) if kind == CARD else F.length(d).between(10, 15))


def iban(text: Column) -> Column:
    """Whether letters and digits pass the test modulo 97 of account numbers."""
    packed = F.translate(text, " ", "")
    turned = F.concat(F.substring(packed, 5, F.lit(40)), F.substring(packed, 1, F.lit(4)))
    value = lambda c: F.when(F.ascii(c) >= 65, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
    step = lambda s, c: (s * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(c)) % 97
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), step) == 1


def _vote(yes: Column, no: Column | None = None) -> Column:
    return F.when(yes, YES).when(F.lit(True) if no is None else no, NO).otherwise(0)


def _labeled(kind: int, x: Column, loose: bool) -> Column:
    """A candidate with its labelers' votes (``v``, base 3) and its cell of classifier features (``c``)."""
    m, left, right = x["m"], F.lower(x["l"]), x["r"]
    digits = _digits(m)
    if kind == SECRET:  # digests in hexadecimal, or letters of both cases with digits
        valid = m.rlike("^(?:[0-9a-f]{32,}|[0-9A-F]{32,})$") | (m.rlike("[a-z]") & m.rlike("[A-Z]") & m.rlike("[0-9]")) | m.rlike(SECRET_PREFIXES)
    elif kind == IBAN:
        valid = iban(m)
    elif kind == SSN:
        valid = ~m.rlike("^(?:000|666|9)|-00-|-0000$")
    else:
        valid = F.lit(False) if loose else _valid(kind, m)
    cue = left.rlike(CUES[kind])
    touched = left.rlike(r"[\p{L}0-9#/_]$" if kind == SECRET else r"[\p{L}0-9#=/_]$") | right.rlike(r"[\p{L}0-9_]")
    anti = DIGEST_NAMES if kind == SECRET else ANTI_CUES
    if kind == EMAIL:
        gaz = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TOP_DOMAINS.split())
        form, off = F.length(F.regexp_extract(m, r"^[^@(\[{]*", 0)).between(2, 64), F.lit(False)
    elif kind == IP:
        gaz = m.rlike("^[23fF]") if loose else let(F.regexp_extract(m, r"^0*([0-9]{0,3})", 1), lambda o: (F.length(o) > 0) & ~o.isin("127", "255"))
        form, off = ~m.rlike(r"(?:^|[.:])0[0-9]"), F.lit(False)
    elif kind == CARD:
        gaz = digits.rlike(CARD_PREFIXES)
        form, off = m.rlike(r"^(?:[0-9]{14,19}|[0-9]{4}([ -])(?:[0-9]{4}\1){2}[0-9]{1,7}|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5})$"), ~F.length(digits).between(14, 19)
    elif kind == SECRET:
        gaz = left.rlike(SECRET_NAMES) | m.rlike(SECRET_PREFIXES)
        form, off = F.length(m).between(20, 256) & (F.length(digits) * 8 >= F.length(m)), F.lit(True)
    elif kind == IBAN:
        gaz = F.substring(m, 1, F.lit(2)).isin(*IBAN_COUNTRIES.split())
        form, off = F.length(F.translate(m, " ", "")).between(15, 34), F.lit(True)
    elif kind == SSN:
        gaz = left.rlike(r"ssn|social|security")
        form, off = F.lit(True), F.lit(False)
    else:
        gaz = digits.rlike("^[2-9][0-9]{2}[2-9]") if loose else m.rlike(COUNTRY_CODES)
        form, off = F.length(digits).between(10, 13) & ~m.rlike(r"[ .()-]{3}"), F.length(digits) > 15
    tested = not loose or kind >= len(BASE_KINDS)
    votes = (_vote(valid) if tested else F.lit(0), _vote(gaz), F.when(cue, YES).otherwise(0), F.when(touched | left.rlike(anti), NO).otherwise(0), _vote(form, off))
    code = F.lit(0)
    for v in votes:
        code = code * VOTES + v
    side = lambda c: F.when(c.isNull() | (c == ""), 0).when(c.rlike(r"[\p{L}0-9_]"), 1).when(c.rlike(r"\s"), 2).otherwise(3)
    size = F.when(F.length(m) < 10, 0).when(F.length(m) < 16, 1).when(F.length(m) < 24, 2).otherwise(3)
    share = F.floor(F.length(digits) * 3 / (F.length(m) + 1)).cast("int")
    cell = F.lit(kind)
    for value, many in ((side(F.right(left, F.lit(1))), 4), (side(right), 4), (size, 4), (share, 3), (cue.cast("int"), 2), (F.when(valid, 2).otherwise(1 if tested else 0), 3)):
        cell = cell * many + value
    return F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e"), (F.lit(False) if loose else valid).alias("base"), code.cast("int").alias("v"), cell.cast("int").alias("c"))


#: Features of a cell after its kind, with their numbers of values.
FEATURES = (4, 4, 4, 3, 2, 3)
CELLS = len(KINDS) * math.prod(FEATURES)
_NONE = "array<struct<s:bigint,k:int,e:bigint,base:boolean,v:int,c:int>>"


def candidates(text: Column) -> Column:
    """All candidates of a text, base matches (valid or not) and loose ones."""
    found = []
    for kind in range(len(KINDS)):
        label = lambda loose, k=kind: lambda x: _labeled(k, x, loose)
        here = []
        if kind in BASE:
            hits = matches(text, BASE[kind])
            if kind == CARD:  # shorter runs of digits are no candidates
                hits = F.filter(hits, lambda x: F.length(x["m"]) >= 13)
            here.append(F.transform(hits, label(False)))
        if kind in LOOSE:
            hits = matches(text, LOOSE[kind])
            if kind == IBAN:  # others are no account numbers
                hits = F.filter(hits, lambda x: iban(x["m"]))
            here.append(F.transform(hits, label(True)))
        one = F.concat(*here) if len(here) > 1 else here[0]
        found.append(F.when(text.rlike(GUARD[kind]), one).otherwise(F.array().cast(_NONE)))
    return F.concat(*found)


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 50) -> tuple[list[float], list[list[list[float]]]]:
    """Expectation-maximisation over vote patterns: ``{(kind, pattern): n}`` to the posterior of every (kind, pattern), and P(vote | class) per labeler.

    Labelers are taken as independent given the class; each kind has its own prior.
    """
    votes = [[p // VOTES ** (len(LABELERS) - 1 - j) % VOTES for j in range(len(LABELERS))] for p in range(PATTERNS)]
    table_ = [[[0.6, 0.3, 0.1], [0.4, 0.1, 0.5]] for _ in LABELERS]
    prior = [0.5] * len(KINDS)

    def posterior(k: int, p: int) -> float:
        on, off = math.log(prior[k]), math.log(1 - prior[k])
        for j, v in enumerate(votes[p]):
            on, off = on + math.log(table_[j][1][v]), off + math.log(table_[j][0][v])
        return 1 / (1 + math.exp(min(700.0, off - on)))

    for _ in range(rounds if counts else 0):
        mass = [[[1.0] * VOTES, [1.0] * VOTES] for _ in LABELERS]
        for v in mass:  # a labeler is taken to be better than chance
            v[0][NO] += 2.0
            v[1][YES] += 2.0
        up, all_ = [1.0] * len(KINDS), [2.0] * len(KINDS)
        for (k, p), n in sorted(counts.items()):
            q = posterior(k, p)
            up[k], all_[k] = up[k] + n * q, all_[k] + n
            for j, v in enumerate(votes[p]):
                mass[j][1][v] += n * q
                mass[j][0][v] += n * (1 - q)
        table_ = [[[x / sum(side) for x in side] for side in labeler] for labeler in mass]
        prior = [min(0.99, max(0.01, a / b)) for a, b in zip(up, all_, strict=True)]
    return [posterior(k, p) for k in range(len(KINDS)) for p in range(PATTERNS)], table_


def classifier(cells: dict[int, tuple[float, float]], rounds: int = 400, rate: float = 1.0, keep: float = 1e-3) -> list[float]:
    """Logistic regression on ``{cell: (rows, sum of posteriors)}``: a probability for every cell."""
    widths = [len(KINDS), *FEATURES]

    def active(cell: int) -> list[int]:
        at, out = sum(widths), []
        for w in reversed(widths):
            at -= w
            out.append(at + cell % w)
            cell //= w
        return out

    weights = [0.0] * sum(widths)
    grown = [1e-9] * len(weights)
    rows = sum(n for n, _ in cells.values()) or 1.0
    data = [(active(c), n / rows, up / rows) for c, (n, up) in sorted(cells.items())]
    prob = lambda a: 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(weights[i] for i in a)))))
    for _ in range(rounds if data else 0):
        grad = [keep * w for w in weights]
        for a, n, up in data:
            g = n * prob(a) - up
            for i in a:
                grad[i] += g
        for i, g in enumerate(grad):
            grown[i] += g * g
            weights[i] -= rate * g / math.sqrt(grown[i])
    return [prob(active(c)) for c in range(CELLS)]


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = ACCEPT) -> DataFrame:
    """``(id, base, added)`` for every row: sorted arrays of ``(s, k, e)``.

    Base spans are exactly the valid base matches.  Added ones are other
    candidates that the trained classifier accepts and that touch no base span.
    Null and empty texts have none; repeated rows stay repeated.  Each text is
    read once; what is shuffled are counts per vote pattern and per cell, both
    of fixed size (1701 and 8064 rows at most), on which the models are fitted.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = save(docs.select(F.col(id_col).alias("id"), candidates(text).alias("x")), "candidates")
    flat = found.select(F.explode("x").alias("x")).select("x.*")
    counts = {(r["k"], r["v"]): r["count"] for r in flat.groupBy("k", "v").count().collect()}
    posteriors, _ = reliabilities(counts)
    soft = F.get(F.expr(f"array({', '.join(f'{p:.9f}D' for p in posteriors)})"), F.col("k") * PATTERNS + F.col("v"))
    cells = {r["c"]: (float(r["n"]), float(r["up"])) for r in flat.groupBy("c").agg(F.count("*").alias("n"), F.sum((soft * 1e9).cast("decimal(30,0)")).alias("up")).collect()}
    cells = {c: (n, up / 1e9) for c, (n, up) in cells.items()}
    good = [c for c, p in enumerate(classifier(cells)) if p >= accept and c in cells]
    short = lambda a: F.sort_array(F.transform(a, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    base = short(F.filter("x", lambda x: x["base"]))
    wanted = F.array(*[F.lit(c) for c in good]) if good else F.array().cast("array<int>")
    more = F.filter("x", lambda x: ~x["base"] & F.array_contains(wanted, x["c"]))
    out = found.select("id", base.alias("base"), more.alias("more"))
    clear = F.filter("more", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (b["e"] > x["s"])))
    return out.select("id", "base", F.array_distinct(short(clear)).alias("added"))


def _listed(a: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))))


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    out = spans(table(spark, sf_dir, "documents", "doc_id", "text"))
    is_kind = lambda k: lambda x: x["k"] == k
    count = [F.size(F.filter("base", is_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    every = F.sort_array(F.concat("base", "added"))
    return out.select(F.col("id").alias("doc_id"), *count, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(every).alias("spans"), F.size("added").cast("long").alias("n_added"), F.size(every).cast("long").alias("n_spans"))
