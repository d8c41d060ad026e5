"""Personal data: candidate spans, judged by boosted trees over format and context, selected by calibrated thresholds.

High-recall generators propose spans, which may overlap: the base forms, and looser ones (addresses spelled out, numbers inside
longer runs of digits, other separators, no country code). Each candidate has small whole numbers for features (form, digits,
separators, neighbouring characters, cue words before it) and a check of its content that no feature knows (Luhn, ranges, a
top-level domain of letters). Trees learn how often candidates of a format and context pass their check: random digits pass at a
known rate, personal data always. From documents that the trees have not seen, monotone steps turn a score into that rate, and the
rate less chance into the share of real ones among those that pass; a kind's threshold is the score where it reaches ``share``.
Base spans always stay. What is added passes its check and the threshold and touches no base span; added spans of a kind that
overlap are one span.

DataFrame functions only. Texts are read once and not moved: candidates, narrow rows, are written, then counted by feature values.
Boosting sees those counts, never documents. One split costs a grouped sum over them, and the driver sees the sums: features times
values times two nodes.

Defined results for odd rows: null and empty texts have no spans; rows are judged each by its own text, so repeated and null doc_ids
are rows of their own; texts of any length are read whole, and no pattern goes back over what it has read; without a
candidate there are no trees, and only base spans are found; an empty table gives no row; further columns are not read, whatever
their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import stored, table

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Base forms (fixed values), written so that they match what they say without going back.
BASE = {
    EMAIL: r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    IP: r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    CARD: r"[0-9](?:[ -]?+[0-9])++",
    PHONE: r"\+[0-9][ ().0-9-]+[0-9]",
}
_AT = r"(?:\s?[\[({<]\s?(?:at|AT|At|@)\s?[\])}>]\s?| @ ?|@ )"
_DOT = r"(?:\s?[\[({<]\s?(?:dot|DOT|Dot|\.)\s?[\])}>]\s?| (?:dot|DOT) |\.)"
_NAME, _LABEL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+", r"[A-Za-z0-9-]{1,63}+"
_QUAD = r"[0-9]{4}"
#: Looser forms: (kind, pattern), the n-th of them has form n.
LOOSE = (
    (EMAIL, rf"{_NAME}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,6}}+"),
    (EMAIL, rf"{_NAME} (?:at|AT) {_LABEL}(?: (?:dot|DOT) {_LABEL}){{1,6}}+"),
    (IP, r"(?<![0-9.])[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)| dot )[0-9]{1,3}+){3}+(?![0-9])"),
    (IP, r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])"),
    (IP, r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){1,5}+::(?:[0-9A-Fa-f]{1,4}+(?::[0-9A-Fa-f]{1,4}+){0,4}+)?+(?![0-9A-Za-z:])"),
    (CARD, rf"(?<![0-9]){_QUAD}[ -]?{_QUAD}[ -]?{_QUAD}[ -]?{_QUAD}(?![0-9])"),
    (CARD, rf"(?<![0-9]){_QUAD}([._/]|  | - ){_QUAD}\1{_QUAD}\1{_QUAD}(?![0-9])"),
    (CARD, r"(?<![0-9])3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9])"),
    (PHONE, r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![0-9])"),
    (PHONE, r"(?<![0-9+(.-])(?:1[ .-])?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}(?![0-9])"),
    (PHONE, r"(?<![0-9])00[1-9][0-9]{0,2}[ .-]\(?[0-9]{1,4}\)?(?:[ .-][0-9]{2,4}){1,4}+(?![0-9])"),
)
#: Words that speak for a kind, and words that speak for other numbers, within ``CONTEXT`` letters before a candidate.
CUES = ("e-?mail|mail|contact|write to", "ip|server|host|address|ping|gateway", "card|visa|master|credit|account|payment|konto|carte|tarjeta", "phone|tel|call|mobile|fax|sms|whats")
OTHER_CUES = "token|key|id|order|ref|isbn|sku|version|hash|serial|invoice|no\\.|#"
CONTEXT = 32
#: Rate at which content that is no personal data passes the check of its kind.
CHANCE = (0.0, 0.0, 0.1, 0.0)
FEATURES = ("kind", "form", "digits", "seps", "left", "right", "cue", "size", "lead", "variety")
_OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]{1,2})"


def _found(text: Column, pattern: str, kind: int, form: int) -> Column:
    """What a generator finds, in order, as structs: letters between it and what was found before, its text, its surroundings."""
    n = F.size(F.regexp_extract_all(text, F.lit(pattern), 0))
    parts, spans = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    one = lambda p: F.struct(
        F.lit(kind).alias("kind"), F.lit(form).alias("form"), F.char_length(p["0"]).alias("gap"), F.right(p["0"], F.lit(CONTEXT)).alias("before"), p["1"].alias("value"), F.left(p["2"], F.lit(1)).alias("after"),
    )
    made = F.transform(F.arrays_zip(F.slice(parts, 1, n).alias("0"), spans.alias("1"), F.slice(parts, F.lit(2), n).alias("2")), one)
    return F.when(text.rlike(pattern), made).otherwise(F.array().cast("array<struct<kind:int,form:int,gap:int,before:string,value:string,after:string>>"))


def _side(c: Column) -> Column:
    """A class of the character beside a span."""
    return F.when(c == "", 0).when(c.rlike(r"\s"), 1).when(c.rlike(r"\p{L}"), 2).when(c.rlike("[0-9]"), 3).when(c.rlike("[\"'=:#_/@-]"), 4).otherwise(5)


def candidates(docs: DataFrame, text: str, keep: list[Column]) -> DataFrame:
    """A row for each candidate and one (kind -1) for each row of ``docs``: _row, ``keep``, _gen and _i (generator and place in what
    it found), _gap and _size (letters), _base, _passes, and the features."""
    whole = F.coalesce(F.col(text), F.lit(""))
    row = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, whole.alias("_text"))
    forms = [(kind, pattern, 0) for kind, pattern in BASE.items()] + [(kind, pattern, n) for n, (kind, pattern) in enumerate(LOOSE, 1)]
    none = F.struct(*(F.lit(v).alias(n) for n, v in (("kind", -1), ("form", 0), ("gap", 0), ("before", ""), ("value", ""), ("after", ""))))
    lists = [F.transform(_found(F.col("_text"), p, k, f), lambda c, i: F.struct(i.alias("i"), c.alias("c"))) for k, p, f in forms]
    kept = [c for c in row.columns if c != "_text"]
    each = row.select(*kept, F.explode(F.concat(F.array(F.struct(F.lit(0).alias("i"), none.alias("c"))), *lists)).alias("_c")).select(*kept, F.col("_c.i").alias("_i"), "_c.c.*")
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length(digits)
    seps = F.regexp_replace("value", "[A-Za-z0-9]", "")
    kind = F.col("kind")
    octets = F.col("value").rlike(rf"^{_OCTET}(?:[^0-9]+{_OCTET}){{3}}$")
    luhn = F.when(n.between(13, 19), F.expr("luhn_check(regexp_replace(value, '[^0-9]', ''))")).otherwise(False)
    base = (F.col("form") == 0) & F.when(kind == EMAIL, True).when(kind == IP, octets).when(kind == CARD, n.between(16, 19) & luhn).when(kind == PHONE, n.between(8, 15)).otherwise(False)
    email = F.col("value").rlike(r"^[A-Za-z0-9](?s:.*)[A-Za-z]{2,24}$") & ~F.contains("value", F.lit(".."))
    six = F.contains("value", F.lit(":")) & F.col("value").rlike("[0-9]")
    passes = F.when(kind == EMAIL, email).when(kind == IP, octets | six).when(kind == CARD, luhn).otherwise(n.between(8, 15) & (F.size(F.array_distinct(F.split(digits, ""))) > 2))
    low = F.lower("before")
    own = reduce(lambda a, k: F.when(kind == k, low.rlike(rf"\b(?:{CUES[k]})")).otherwise(a), range(4), F.lit(False))
    cue = F.when(own, 1).when(low.rlike(rf"\b(?:{OTHER_CUES})"), 2).when(low.rlike(rf"\b(?:{'|'.join(CUES)})"), 3).otherwise(0)
    values = {
        "kind": kind, "form": F.col("form"), "digits": F.least(n, F.lit(24)),
        "seps": F.when(seps == "", 0).when(seps.rlike("^ +$"), 1).when(seps.rlike("^-+$"), 2).when(seps.rlike(r"^\.+$"), 3).when(seps.rlike("[()]"), 4).otherwise(5),
        "left": _side(F.right("before", F.lit(1))), "right": _side(F.col("after")), "cue": cue, "size": F.least(F.expr("char_length(value) div 4"), F.lit(15)),
        "lead": F.when(n > 0, F.left(digits, F.lit(1)).cast("int")).otherwise(-1), "variety": F.least(F.size(F.array_distinct(F.split(digits, ""))), F.lit(10)),
    }
    gen = reduce(lambda a, g: F.when((kind == g[1][0]) & (F.col("form") == g[1][2]), g[0]).otherwise(a), enumerate(forms), F.lit(-1))
    return each.select(*kept, gen.alias("_gen"), "_i", F.col("gap").alias("_gap"), F.char_length("value").alias("_size"), base.alias("_base"), F.coalesce(passes, F.lit(False)).alias("_passes"), *(c.cast("int").alias("f_" + name) for name, c in values.items()))


@dataclass
class Trees:
    """Boosted trees of depth two over whole-number features, and for each kind the score from which spans are selected."""

    start: float = 0.0
    trees: list = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    @staticmethod
    def _goes_left(split: tuple[int, str, int]) -> Column:
        at, how, value = split
        column = F.col("f_" + FEATURES[at])
        return column <= value if how == "<=" else column == value

    def margin(self) -> Column:
        total = F.lit(self.start)
        for split, (a, left), (b, right) in self.trees:
            side = lambda s, v: F.lit(v[0]) if s is None else F.when(self._goes_left(s), v[0]).otherwise(v[1])
            total = total + F.when(self._goes_left(split), side(a, left)).otherwise(side(b, right))
        return total

    def selects(self) -> Column:
        return reduce(lambda a, t: F.when(F.col("f_kind") == t[0], F.col("_margin") >= t[1]).otherwise(a), self.thresholds.items(), F.lit(False))


def _best_split(cells: dict[tuple[int, int], tuple[float, float]], penalty: float, least: float):
    """The split of a node with most gain, from gradient and curvature sums by (feature, value): (gain, split, leaf values)."""
    by: dict[int, list] = {}
    for (at, value), sums in sorted(cells.items()):
        by.setdefault(at, []).append((value, *sums))
    best = None
    for at, rows in by.items():
        g, h = sum(r[1] for r in rows), sum(r[2] for r in rows)
        gl = hl = 0.0
        for value, rg, rh in rows:
            gl, hl = gl + rg, hl + rh
            for how, a, b in (("<=", gl, hl), ("==", rg, rh)):
                if b < least or h - b < least:
                    continue
                gain = round(a * a / (b + penalty) + (g - a) ** 2 / (h - b + penalty) - g * g / (h + penalty), 6)
                if best is None or gain > best[0]:
                    best = gain, (at, how, value), (-a / (b + penalty), -(g - a) / (h - b + penalty))
    return best


def fit(counts: DataFrame, rounds: int = 12, rate: float = 0.5, penalty: float = 1.0, least: float = 1.0) -> Trees:
    """Boost logistic loss over ``counts`` (the features, n, passed): two grouped sums for each tree of depth two."""
    total = counts.agg(F.sum("n").alias("n"), F.sum("passed").alias("y")).first()
    model = Trees()
    if not total.n:
        return model
    share = (total.y + 0.5) / (total.n + 1)
    model.start = math.log(share / (1 - share))
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("at"), F.col("f_" + c).alias("value")) for i, c in enumerate(FEATURES)))).alias("_v")

    def sums(node: Column) -> dict[int, dict]:
        p = 1 / (1 + F.exp(-model.margin()))
        rows = counts.select(*counts.columns, p.alias("_p")).select((F.col("n") * F.col("_p") - F.col("passed")).alias("g"), (F.col("n") * F.col("_p") * (1 - F.col("_p"))).alias("h"), node.alias("node"), values)
        out: dict[int, dict] = {}
        for r in rows.groupBy("node", "_v.at", "_v.value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r.node, {})[r.at, r.value] = (r.g, r.h)
        return out

    for _ in range(rounds):
        top = _best_split(sums(F.lit(0))[0], penalty, least)
        if top is None or top[0] <= 1e-4:
            break
        below = sums(F.when(Trees._goes_left(top[1]), 0).otherwise(1))
        sides = []
        for node in (0, 1):
            found = _best_split(below.get(node, {}), penalty, least)
            values_of = (top[2][node], top[2][node]) if found is None else found[2]
            sides.append((found and found[1], tuple(rate * v for v in values_of)))
        model.trees.append((top[1], *sides))
    return model


def monotone(rates: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """(from score, rate) steps that never fall, of bins (score, passed, n): neighbours that fall are pooled."""
    steps: list[list[float]] = []
    for at, y, n in sorted(rates):
        steps.append([at, y, n])
        while len(steps) > 1 and steps[-2][1] * steps[-1][2] >= steps[-1][1] * steps[-2][2]:
            _, y1, n1 = steps.pop()
            steps[-1][1] += y1
            steps[-1][2] += n1
    return [(at, y / n) for at, y, n in steps]


def calibrate(model: Trees, counts: DataFrame, share: float = 0.5, bin_of: float = 0.25) -> Trees:
    """Thresholds by kind from ``counts`` of documents that the trees have not seen: of what passes its check at that score, ``share`` is
    more than chance. A kind without such documents keeps the score as it is."""
    bins = counts.withColumn("_b", F.floor(model.margin() / bin_of)).groupBy("f_kind", "_b").agg(F.sum("n").alias("n"), F.sum("passed").alias("y")).collect()
    for kind in range(len(KINDS)):
        chance = CHANCE[kind]
        real = lambda p, c=chance: max(p - c, 0) / (1 - c) / p if p else 0.0
        rows = [(r["_b"] * bin_of, float(r.y), float(r.n)) for r in bins if r.f_kind == kind]
        if not rows:
            # the rate p at which (p - c) / (1 - c) / p = share
            p = min(max(chance / (1 - share * (1 - chance)), 0.5), 1 - 1e-9)
            model.thresholds[kind] = math.log(p / (1 - p))
            continue
        good = [at for at, rate in monotone(rows) if real(rate) >= share]
        model.thresholds[kind] = min(good) if good else math.inf
    return model


def train(found: DataFrame, doc_id: str = "doc_id", share: float = 0.5, rounds: int = 12) -> Trees:
    """Trees from four fifths of the documents (by crc32 of doc_id), thresholds from the rest; all their candidates are counted."""
    held = F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
    counts = found.where("f_kind >= 0").groupBy(held.alias("_held"), *("f_" + c for c in FEATURES)).agg(F.count("*").alias("n"), F.count_if("_passes").alias("passed"))
    counts = stored(counts, "pii-counts")
    return calibrate(fit(counts.where("NOT _held").drop("_held"), rounds), counts.where("_held"), share)


def select(found: DataFrame, model: Trees, keep: list[str]) -> DataFrame:
    """(_row, ``keep``, spans, bases) for each row: structs (kind, start, end) in order, of all selected spans and of the base ones."""
    dealt = found.repartition("_row")
    so_far = Window.partitionBy("_row", "_gen").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("_gap") + F.col("_size")).over(so_far)
    placed = dealt.withColumn("end", end).withColumn("start", F.col("end") - F.col("_size")).withColumn("_margin", model.margin())
    chosen = placed.where((F.col("f_kind") < 0) | F.col("_base") | (F.col("_passes") & model.selects())).select("_row", *keep, F.col("f_kind").alias("kind"), F.col("_base").alias("base"), "start", "end")
    row = Window.partitionBy("_row").orderBy("start")
    real = F.col("kind") >= 0
    before = F.max(F.when(F.col("base"), F.col("end"))).over(row.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(F.col("base"), F.col("start"))).over(row.rangeBetween(1, Window.unboundedFollowing))
    touches = F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("end"), F.lit(False))
    apart = chosen.withColumn("_touches", real & touches).where("base OR NOT _touches")
    kin = Window.partitionBy("_row", "kind", "base").orderBy("start", F.desc("end"))
    reach = F.max("end").over(kin.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("base") | reach.isNull() | (F.col("start") >= reach)
    island = F.sum(F.col("_new").cast("long")).over(kin.rowsBetween(Window.unboundedPreceding, 0))
    merged = apart.withColumn("_new", new).withColumn("_island", island).groupBy("_row", *keep, "kind", "base", "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    span = F.struct("kind", "start", "end")
    return merged.groupBy("_row", *keep).agg(F.sort_array(F.collect_list(F.when(F.col("kind") >= 0, span))).alias("spans"), F.sort_array(F.collect_list(F.when(F.col("base"), span))).alias("bases"))


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.5, model: Trees | None = None) -> DataFrame:
    """(doc_id, spans, bases) of each row of ``docs``; trees are trained on ``docs`` unless a ``model`` is given."""
    found = stored(candidates(docs, text, [F.col(doc_id).alias("doc_id")]), "pii-candidates")
    return select(found, model or train(found, "doc_id", share), ["doc_id"]).drop("_row")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = spans_of(table(spark, sf_dir, "documents", "doc_id", "text"))
    kinds = F.transform("bases", lambda s: s["kind"])
    counts = [F.size(F.filter(kinds, F.lit(k).__eq__)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(as_text(F.col("bases")), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"))
