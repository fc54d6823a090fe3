"""Personal data by weak supervision, in DataFrame functions alone."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch, text_of

#: The kinds in their order, and what their base spans look like. The
#: look-behinds and possessive quantifiers only spare attempts that cannot match.
KINDS = ("email", "ip", "card", "phone")
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without this has no span of the kind.
HINT = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){13}[0-9]", "phone": r"\+[0-9]"}
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
#: Wider shapes whose matches are candidates too: disguised, defanged, otherwise separated, or too little.
AT, DOT = r"\x20?[(\[]\x20?at\x20?[)\]]\x20?", r"\x20?[(\[]\x20?dot\x20?[)\]]\x20?"
WIDE = {
    "email": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:(?:{AT})[A-Za-z0-9-]{{1,63}}(?:{DOT}|\.)[A-Za-z]{{2,10}}\b|\x20at\x20[A-Za-z0-9-]{{1,63}}(?:{DOT}|\x20dot\x20)[A-Za-z]{{2,10}}\b|@[A-Za-z0-9-]{{1,63}}(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){2}[\x20._/-]{1,3}[0-9]{2,7}(?![0-9])",
    "phone": r"(?<![0-9A-Za-z+.-])\(?[0-9]{3}\)?[\x20.-]?[0-9]{3}[\x20.-][0-9]{4}(?![0-9A-Za-z-])",
}
WIDE_HINT = {"email": r"@|[(\[]\x20?at\x20?[)\]]|\x20at\x20[A-Za-z0-9-]+\x20?[(\[]?\x20?dot", "ip": r"\[\.\]", "card": r"[0-9]{4}[\x20._/-]{1,3}[0-9]{4}[\x20._/-]", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
#: Fixed values, the gazetteers: ends of host names, ...
TOP_LEVEL = (
    "com net org edu gov mil int info biz name pro aero coop museum mobi jobs travel tel asia cat post xxx io ai app dev me tv co cc ws fm gg sh ly xyz online site store tech blog cloud shop live news agency email "
    "ar at au be bg br ca ch cl cn cz de dk ee es eu fi fr gr hk hr hu id ie il in is it jp kr lt lu lv mx my nl no nz pe ph pk pl pt ro rs ru sa se sg si sk th tr tw ua uk us uy ve vn za"
).split()
#: ... issuers of cards by their first digits, ...
ISSUERS = "4 51 52 53 54 55 2[2-7] 34 37 36 38 39 30[0-5] 6011 64[4-9] 65 62 35[2-8] 50[18] 56 57 58 63 67".split()
#: ... country codes of telephones by their first digits, ...
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 5[1-8] 6[0-6] 81 82 84 86 9[0-58] 21[0-9] 22[0-9] 23[0-9] 24[0-9] 25[0-8] 26[0-9] 29[0-9] 35[0-9] 37[0-9] 38[0-9] 42[0-9] 50[0-9] 59[0-9] 67[0-9] 68[0-9] 69[0-2] 80[08] 85[0-6] 87[0-8] 88[0-8] 96[0-8] 97[0-79] 99[0-8]".split()
#: ... North American area and exchange codes, as their plan has them, and networks that hosts have.
AREA = r"^\(?[2-9](?:1[02-9]|[02-8][0-9])\)?[\x20.-]?[2-9](?:1[02-9]|[02-9][0-9])"
NETWORK = r"^(?!127\b)(?:[1-9]|[1-9][0-9]|1[0-9]{2}|2[01][0-9]|22[0-3])(?:\.|\[)"
GAZETTEER = {
    "email": rf"(?i)[.\x20)\]](?:{'|'.join(TOP_LEVEL)})$",
    "ip": NETWORK,
    "card": rf"^(?:{'|'.join(ISSUERS)})",
    "phone": rf"^\+(?:{'|'.join(CALLING)})|{AREA}",
}
#: Words near a span that speak for its kind, and such that speak against any.
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach|address|inbox|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ipv4|host|hostname|server|address|network|login|client|gateway|dns|subnet|proxy)\b",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment|paid|cvv|expir\w*|tarjeta|carte|karte)\b",
    "phone": r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|contact|sms|whatsapp|hotline|telefon|handy)\b",
}
AGAINST = r"(?i)\b(?:version|release|build|sha|hash|isbn|issn|doi|serial|order|invoice|id|ref|token|sku|chapter|section|page|figure|rfc|total|sum|item|part|model)\b"
#: Made up for examples: one digit throughout, digits in a row, hosts for documentation.
EXAMPLE = {
    "email": r"(?i)@(?:example|test|localhost|invalid)\b|^(?:user|name|you|someone)@",
    "ip": r"^(?:[0-9]\.){3}[0-9]$|^0",
    "card": r"^([0-9])(?:[\x20._/-]*\1)+$|^0",
    "phone": r"([0-9])(?:[\x20().-]*\1){6}|123[\x20.-]?456[\x20.-]?7890",
}
NEAR = 40
#: Votes of a labeler: against, for, none.
NO, YES, NONE = 0, 1, 2
#: The labelers: form, gazetteer, context, example. After their votes come three signs.
LABELERS = 4
FEATURES = 2 * LABELERS + 4
#: Characters that mark matches and hide them; texts that hold them are matched as if they held another control character.
MARK, OTHER, HIDDEN = "\x01", "\x02", "\x03"
#: Elements that are summed one by one; longer arrays are summed in such blocks.
RUN = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def nothing(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


MATCH = "struct<s:int,e:int,t:string,near:string,form:int>"
CANDIDATE = "struct<s:int,e:int,kind:int,base:boolean,v:array<int>>"


def upto(n: Column) -> Column:
    """0, 1, ..., n - 1; n is 1 at least."""
    return F.sequence(F.lit(0), n - 1)


def sums_before(sizes: Column) -> Column:
    """Of each element the sum of those before it. Blocks are summed alone, so
    the copies of a growing array stay small however many elements there are."""

    def running(of: Column, start: Column) -> Column:
        first = F.struct(start.alias("at"), nothing("int").alias("out"))
        return F.aggregate(of, first, lambda held, x: F.struct((held["at"] + x).alias("at"), F.concat(held["out"], F.array(held["at"])).alias("out")), lambda held: held["out"])

    def in_blocks(sizes: Column) -> Column:
        block = lambda b: F.slice(sizes, b * RUN + 1, F.lit(RUN))
        blocks = upto(F.ceil(F.size(sizes) / RUN).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(block(b), F.lit(0), lambda a, x: a + x))
        return let(running(totals, F.lit(0)), lambda starts: F.flatten(F.transform(blocks, lambda b: running(block(b), F.element_at(starts, b + 1)))))

    return let(sizes, in_blocks)


def cut(text: Column, pattern: str) -> Column:
    """The text cut at what the pattern matches, leftmost and without overlap: gaps in even places, matches in odd ones."""
    return F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def matches(parts: Column, form: Callable[[Column], Column]) -> Column:
    """The matches of a cut text: (s, e, t, near, form); s and e count code points, near is the text around."""

    def one(at: Column) -> Callable[[Column], Column]:
        def match(i: Column) -> Column:
            part = lambda k: F.element_at(parts, 2 * i + k)
            start = F.element_at(at, 2 * i + 2)
            near = F.concat(F.substring(part(1), -NEAR, NEAR), F.lit(" "), F.substring(part(3), 1, NEAR))
            return F.struct(start.alias("s"), (start + F.char_length(part(2))).alias("e"), part(2).alias("t"), near.alias("near"), form(part(2)).cast("int").alias("form"))

        return match

    found = let(sums_before(F.transform(parts, F.char_length)), lambda at: F.transform(upto(F.floor(F.size(parts) / 2).cast("int")), one(at)))
    return F.when(F.size(parts) > 1, found).otherwise(nothing(MATCH))


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check."""
    n = F.char_length(number)
    values = F.transform(F.sequence(F.lit(1), n), lambda i: let(F.substr(number, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)))
    return F.aggregate(values, F.lit(0), lambda a, d: a + d) % 10 == 0


def valid(kind: str, t: Column) -> Column:
    """Whether a match of the base pattern is a base span."""
    if kind == "ip":
        return t.rlike(OCTETS)
    if kind == "card":
        return F.char_length(digits(t)).between(14, 19) & luhn(digits(t))
    if kind == "phone":
        return F.char_length(digits(t)).between(10, 15)
    return F.lit(True)


def base_form(kind: str, t: Column) -> Column:
    """YES for a base span; NO for a match that fails the check but comes near; null for others."""
    near = {"email": F.lit(True), "ip": t.rlike(r"^[0-9]{1,4}(?:\.[0-9]{1,4}){3}$"), "card": F.char_length(digits(t)).between(14, 19), "phone": F.char_length(digits(t)).between(7, 18)}[kind]
    return F.when(valid(kind, t), YES).when(near, NO)


def wide_form(kind: str, t: Column) -> Column:
    """The form labeler's vote on a match of the wider shape."""
    if kind == "email":
        return F.when(t.rlike(r"[(\[]"), YES).when(t.contains("@"), NO).otherwise(NONE)
    if kind == "ip":
        return F.when(F.regexp_replace(t, r"[\[\]]", "").rlike(OCTETS), YES).otherwise(NO)
    if kind == "card":
        return F.when(F.char_length(digits(t)).between(14, 19) & luhn(digits(t)), YES).otherwise(NO)
    return F.when(t.rlike(AREA), NONE).otherwise(NO)


def votes(kind: str, span: Column) -> Column:
    """The labelers' votes on a match, and its signs, as an array of whole numbers."""
    t, near = span["t"], span["near"]
    gazetteer = F.when(t.rlike(GAZETTEER[kind]), YES).otherwise(NO)
    context = F.when(near.rlike(CONTEXT[kind]), YES).when(near.rlike(AGAINST), NO).otherwise(NONE)
    example = F.when(t.rlike(EXAMPLE[kind]), NO).otherwise(NONE)
    separated = t.rlike(r"[\x20().\[-]").cast("int")
    framed = near.rlike(r"(?:^|\s)\S{0,2}$|^\S{0,2}\s").cast("int")
    marked = t.rlike(r"[@+]").cast("int")
    return F.array(span["form"], gazetteer, context, example, separated, framed, marked)


def _candidates(text: Column, kind: str) -> Column:
    """Base spans, matches that fail the check, and matches of the wider shape that lie in none of these."""

    def voted(base: bool, span: Column) -> Column:
        is_base = (span["form"] == YES) if base else F.lit(False)
        return F.struct(span["s"].alias("s"), span["e"].alias("e"), F.lit(KINDS.index(kind)).alias("kind"), is_base.alias("base"), votes(kind, span).alias("v"))

    def all_of(parts: Column) -> Column:
        base = F.filter(matches(parts, partial(base_form, kind)), lambda x: x["form"].isNotNull())
        hide = lambda p, i: F.when((i % 2 == 1) & base_form(kind, p).isNotNull(), F.repeat(F.lit(HIDDEN), F.char_length(p))).otherwise(p)
        rest = F.when(F.size(parts) > 1, F.array_join(F.transform(parts, hide), "")).otherwise(text)
        wide = let(cut(rest, WIDE[kind]), lambda parts: matches(parts, partial(wide_form, kind)))
        added = F.when(text.rlike(WIDE_HINT[kind]), F.transform(wide, partial(voted, False))).otherwise(nothing(CANDIDATE))
        return F.concat(F.transform(base, partial(voted, True)), added)

    parts = F.when(text.rlike(HINT[kind]), cut(text, BASE[kind])).otherwise(F.array(text))
    return F.when(text.rlike(f"{HINT[kind]}|{WIDE_HINT[kind]}"), let(parts, all_of)).otherwise(nothing(CANDIDATE))


def pii_candidates(docs: DataFrame, text_col: str = "text", *, out_col: str = "pii_candidates") -> DataFrame:
    """docs with out_col: what may be personal data in each whole text, as an array of (s, e, kind, base, v).

    Candidates are the base spans of each kind (base), matches of the base
    pattern that fail its check, and matches of wider shapes in the rest of the
    text; v holds the labelers' votes. Positions count code points, ends are
    exclusive. The work grows in proportion to the text and its matches. Null
    counts as empty. A column named out_col is replaced, others stay. No rows
    give no rows.
    """
    find = lambda text: F.concat(*(_candidates(text, kind) for kind in KINDS))
    text = text_of(text_col)
    found = F.when(text.rlike("[@0-9]|" + WIDE_HINT["email"]), let(F.replace(text, F.lit(MARK), F.lit(OTHER)), find)).otherwise(nothing(CANDIDATE))
    return docs.withColumn(out_col, found)


Rows = Column


def reliabilities(patterns: Rows, more: Rows | None = None, rounds: int = 25, prior: float = 10.0) -> Column:
    """Expectation-maximisation over arrays of (v, n): votes and how often they occur.

    The state holds the share of true spans and, for true and false spans, the
    chance of each vote of each labeler; labelers are taken as independent given
    the truth. They are trusted as far as prior votes would make them, until
    there are more votes. Returns the patterns, and those of more, which teach
    nothing, with the chance q that the span is true.
    """
    trusted, doubted = [0.1, 0.6, 0.3] * LABELERS, [0.5, 0.1, 0.4] * LABELERS

    def chance(table: Column, v: Column) -> Column:
        out = F.lit(1.0)
        for j in range(LABELERS):
            out = out * F.element_at(table, F.element_at(v, j + 1) + 1 + 3 * j)
        return out

    def posterior(state: Column, v: Column) -> Column:
        yes, no = state["p"] * chance(state["a"], v), (1 - state["p"]) * chance(state["b"], v)
        return yes / (yes + no)

    def expect(state: Column, of: Column) -> Column:
        return F.transform(of, lambda x: F.struct(x["v"].alias("v"), x["n"].alias("n"), posterior(state, x["v"]).alias("q")))

    def total(rows: Column, weight: Callable[[Column], Column]) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda s, x: s + weight(x))

    def table(rows: Column, of: Callable[[Column], Column], start: list[float]) -> Column:
        every = total(rows, of) + prior
        cells = [total(rows, lambda x, j=k // 3, c=k % 3: F.when(F.element_at(x["v"], j + 1) == c, of(x)).otherwise(0.0)) + prior * share for k, share in enumerate(start)]
        return F.transform(F.array(*cells), lambda s: s / every)

    def improve(state: Column, _: Column) -> Column:
        def maximise(rows: Column) -> Column:
            true, false = (lambda x: x["n"] * x["q"]), (lambda x: x["n"] * (1 - x["q"]))
            share = (total(rows, true) + prior / 2) / (total(rows, lambda x: x["n"]) + prior)
            return F.struct(share.alias("p"), table(rows, true, trusted).alias("a"), table(rows, false, doubted).alias("b"))

        return let(expect(state, patterns), maximise)

    start = F.struct(F.lit(0.5).alias("p"), F.array(*map(F.lit, trusted)).alias("a"), F.array(*map(F.lit, doubted)).alias("b"))
    fitted = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, improve)
    return let(fitted, lambda state: expect(state, patterns if more is None else F.concat(patterns, more)))


def unseen(patterns: Rows, share: float = 0.25) -> Column:
    """Every pattern of votes, together as often as that share of what was seen, so that the classifier
    learns what the labelers' reliabilities say of votes that the texts did not show."""
    every = [F.array(*map(F.lit, (*v, *signs))) for v in product((NO, YES, NONE), repeat=LABELERS) for signs in ((0, 0, 0), (1, 1, 1))]
    each = (F.aggregate(patterns, F.lit(1.0), lambda s, x: s + x["n"]) * share / len(every)).alias("n")
    return F.transform(F.array(*every), lambda v: F.struct(v.alias("v"), each))


def signs(v: Column) -> Column:
    """The classifier's features of a span's votes and signs."""
    cells = [F.lit(1.0)]
    for j in range(LABELERS):
        cells += [(F.element_at(v, j + 1) == c).cast("double") for c in (YES, NO)]
    cells += [F.element_at(v, LABELERS + 1 + j).cast("double") for j in range(3)]
    return F.array(*cells)


def margin(weights: Column, x: Column) -> Column:
    return F.aggregate(F.zip_with(weights, x, lambda a, b: a * b), F.lit(0.0), lambda s, y: s + y)


def classifier(rows: Column, steps: int = 150, rate: float = 2.0) -> Column:
    """Logistic weights by gradient descent on arrays of (v, n, q): q is the label."""

    def gradient(weights: Column, data: Column) -> Column:
        zero = F.array(*[F.lit(0.0)] * FEATURES)
        return F.aggregate(data, zero, lambda g, d: let(d["n"] * (1 / (1 + F.exp(-margin(weights, d["x"]))) - d["q"]), lambda r: F.zip_with(g, d["x"], lambda a, b: a + r * b)))

    def fit(data: Column) -> Column:
        n = F.aggregate(data, F.lit(0.0), lambda s, d: s + d["n"])
        zero = F.array(*[F.lit(0.0)] * FEATURES)
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, lambda w, _: F.zip_with(w, gradient(w, data), lambda a, g: a * (1 - 1e-4) - rate * g / n))

    return let(F.transform(rows, lambda d: F.struct(signs(d["v"]).alias("x"), d["n"].alias("n"), d["q"].alias("q"))), fit)


@dataclass(frozen=True)
class SpanModel:
    """Weights of the final classifier, by kind."""

    weights: dict[str, tuple[float, ...]]


def fit_pii(candidates: DataFrame, candidates_col: str = "pii_candidates") -> SpanModel:
    """Estimate the labelers' reliabilities from their votes on all candidates and fit the classifier.

    The candidates are counted by kind, votes and signs, at most 648 rows a
    kind; all else works on these. Only the weights come to the driver. A kind
    without candidates gets the weights that the prior reliabilities give.
    """
    cast = candidates.select(F.explode(candidates_col).alias("c")).select("c.kind", "c.v")
    counts = scratch(cast.groupBy("kind", "v").agg(F.count("*").cast("double").alias("n")), "pii-votes")
    by_kind = counts.groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("v", "n"))).alias("rows"))
    kinds = counts.sparkSession.range(len(KINDS)).select(F.col("id").cast("int").alias("kind"))
    rows = kinds.join(by_kind, "kind", "left").select("kind", F.coalesce("rows", nothing("struct<v:array<int>,n:double>")).alias("rows"))
    fitted = rows.select("kind", classifier(reliabilities(F.col("rows"), unseen(F.col("rows")))).alias("weights"))
    return SpanModel({KINDS[r.kind]: tuple(r.weights) for r in fitted.collect()})  # four rows


def find_pii(candidates: DataFrame, model: SpanModel, candidates_col: str = "pii_candidates", *, least: float = 0.5) -> DataFrame:
    """candidates with base_spans and spans, arrays of (s, e, kind) by start, then kind, in place of candidates_col.

    Base spans always stay; spans also holds the other candidates that the
    classifier finds at least `least` likely. Columns named base_spans or spans
    are replaced, others stay. No rows give no rows.
    """

    def likely(x: Column) -> Column:
        margins = F.lit(None).cast("double")
        for k, kind in enumerate(KINDS):
            margins = F.when(x["kind"] == k, margin(F.array(*map(F.lit, model.weights[kind])), signs(x["v"]))).otherwise(margins)
        return 1 / (1 + F.exp(-margins)) >= least

    def ordered(spans: Column) -> Column:
        plain = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["kind"].alias("k"), x["e"].alias("e"))))
        return F.transform(plain, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(F.array(*map(F.lit, KINDS)), x["k"] + 1).alias("kind")))

    found = F.col(candidates_col)
    rows = candidates.drop("base_spans", "spans")
    base, spans = ordered(F.filter(found, lambda x: x["base"])), ordered(F.filter(found, lambda x: x["base"] | likely(x)))
    return rows.select(*(c for c in rows.columns if c != candidates_col), base.alias("base_spans"), spans.alias("spans"))


def written(spans: str) -> Column:
    """The spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
