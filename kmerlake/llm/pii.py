"""Personal data: candidate spans, boosted trees, calibrated thresholds; Spark's own functions.

Generators with high recall propose spans of several kinds, which may overlap:
those of the base (whose matches count when they pass their check) and further
ones for card numbers that were mistyped, national phone numbers, addresses in
words, account numbers, identity numbers and IPv6 addresses.  A candidate is told
by counts of its format and by its surroundings (``FEATURES``).

No text comes with marked spans, so the trees learn from planted ones: ``GRAMMAR``
makes some hundreds of forms of personal data and of numbers that are none, their
characters are drawn by hash, and they are put into places of the corpus itself.  A
candidate over a planted span is positive if that is its kind, negative if it is
none; whether a base check passes plays no part.  ``contexts`` documents, chosen by
hash, lend a place each; that is the bound of the sample.  Boosted depth-two trees
are fitted to counts of equal candidates.  Whole shapes are held out, not places: a
kind's threshold is the lowest score, at least one half, from which the precision on
shapes that the scoring trees have not seen, less two standard errors, reaches
``precision``; a kind that has none adds nothing.

The base spans, those that pass their check, always stay.  The method adds
candidates whose score reaches their kind's threshold and that overlap no base
span; of added spans that overlap the one with the higher score stays.  Scoring is
row by row in SQL expressions; nothing is shuffled for it.

Null text counts as empty; each input row gives one output row, so repeated rows
stay apart.  Texts are read whole.  Without any text to plant in, nothing is
learned and nothing added.  Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from kmerlake.llm.located import located, span_text, with_kind


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    base: bool = True
    needs: str | None = None


#: The base's patterns are the contract's with possessive loops: a run of digits or
#: of address characters is read once, and long runs need no stack.  Runs of fewer
#: than twelve digits, which no card check passes, are no candidates.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", needs="@"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,}+"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", needs="+"),
    Kind("card_like", r"(?<![0-9])(?:[0-9]{13,19}+|[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}+|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9])", base=False),
    Kind("local_phone", r"(?<![0-9A-Za-z])\(?[0-9]{2,5}+\)?(?:[\x20./-]{1,2}[0-9]{2,8}+){1,4}+(?![0-9A-Za-z])", base=False),
    Kind("email_in_words", r"[A-Za-z0-9._%+-]{1,64}+(?:\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,64}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,64}+)++", base=False, needs="at"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", base=False),
    Kind("id_number", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", base=False, needs="-"),
    Kind("ip6", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}+(?::?[0-9A-Fa-f]{1,4}){1,6}+(?![0-9A-Za-z:])", base=False, needs=":"),
)
FEATURES = ("digits", "letters", "longest_run", "groups", "distinct_digits", "separator", "first_digit", "before", "after", "cue", "number_cue", "digits_near", "first_run", "last_run")
_CUE = r"(?i)(mail|phone|tel|fax|call|mobile|cell|contact|reach|card|visa|credit|debit|account|iban|ssn|social|security|passport|host|client|address)(?:\x20(?:number|no|nr|is|was|of))?[^A-Za-z0-9]*$"
_NUMBER = r"(?i)(version|ver|v|no|nr|order|item|id|invoice|ref|reference|section|isbn|build|release|tracking|serial|part|total|sum|rate|page|row|time|date)[^A-Za-z0-9]*$"
#: What is planted, as a grammar: every lead of a line with every shape of it makes a
#: form.  In a shape the span stands between angle brackets; # is a digit, ^ a
#: hexadecimal digit, ? a small and ~ a capital letter.  Kind None is no personal data.
_CARD_LEADS = ("", "card ", "visa ", "credit card: ", "debit ", "his card was ")
_NUMBER_LEADS = ("", "order ", "id ", "tracking ", "serial ", "invoice ", "ref: ", "batch ", "lot ", "code ", "item ", "the key ", "sum ")
_PHONE_LEADS = ("", "call ", "tel ", "phone: ", "mobile ", "fax ", "ring ", "contact me on ")
_PLAIN_LEADS = ("", "on ", "version ", "part ", "page ", "row ", "total ", "from ", "score ", "lot ", "see ")
_WORD_USERS, _WORD_AT = ("?????", "???_??", "???.?????", "???????##"), (" [at] ", " (at) ", "(at)", "[at]")
_WORD_HOSTS = ("?????? dot com", "?????.com", "???? (dot) net", "?????[dot]???????[dot]de", "???? dot co dot uk", "??????.org")
#: Lengths of account numbers by country, fixed values; some have letters after the check digits.
_IBAN = {"DE": 22, "FR": 27, "GB": 22, "ES": 24, "NL": 18, "IT": 27, "BE": 16, "AT": 20, "CH": 21, "PL": 28, "PT": 25, "SE": 24, "DK": 18, "FI": 18, "IE": 22, "LU": 20}
_IBAN_LETTERS = {"GB": 4, "NL": 4, "IE": 4, "IT": 1}


def _iban_shapes() -> tuple[str, ...]:
    whole = [c + "##" + "~" * _IBAN_LETTERS.get(c, 0) + "#" * (n - 4 - _IBAN_LETTERS.get(c, 0)) for c, n in _IBAN.items()]
    return tuple(f"<{x}>" for w in whole for x in (w, " ".join(w[i : i + 4] for i in range(0, len(w), 4))))


GRAMMAR: tuple[tuple[str | None, tuple[str, ...], tuple[str, ...]], ...] = (
    ("card_like", _CARD_LEADS, (
        "<4###############>", "<4### #### #### ####>", "<4###-####-####-####>", "<51##############>", "<55## #### #### ####>", "<53##-####-####-####>", "<2221############>", "<27## #### #### ####>", "<6011############>", "<65## #### #### ####>",
        "<37#############>", "<34## ###### #####>", "<37## ###### #####>", "<4############>", "<36############>", "<62##-####-####-####>",
    )),
    (None, _NUMBER_LEADS, (
        "<################>", "<#############>", "<##############>", "<###############>", "<16###########>", "<17###########>", "<978##########>", "<978-#-##-######-#>", "<2024##############>", "<20##############>", "<#### #### #### ####>", "<####-####-####-####>", "<9##################>",
        "<1##################>", "0.<################>", "$<#############>", "#<################>", "^^^^^^<################>^^^", "?<###############>", "<###############>^?", "_<################>", "<################>_?", "<1Z################>", "<^^^^^^^^-####-####-####-############>", "#.## #.## <#### #### #### ####> #.##",
    )),
    ("local_phone", _PHONE_LEADS, (
        "<(###) ###-####>", "<###-###-####>", "<###.###.####>", "<0## #######>", "<0### ######>", "<0## / ### ## ##>", "<(0##) #### ####>", "<0# ## ## ## ##>", "<### #### ####>", "<0#### ######>", "<0##-#######>", "<(0####) ######>", "<0### ### ###>", "<0## ### ## ##>", "<### ### ####>", "<0###/######>", "<(0#) #### ####>", "<0## #### ####>",
    )),
    (None, _PLAIN_LEADS, (
        "<20##-##-##>", "<##.##.20##>", "<##/##/20##>", "<19##-19##>", "<###-##-##-###>", "<##.##.###>", "<## ### ###>", "<###-####-##>", "<#### ####>", "<##.###,##>", "<###.###.###>", "<###-###>", "<20##-##-## ##>", "<## ## ## ##>", "<##-##-##>", "<###/###/##>", "<#### - ####>", "<### ## ##>", "<20##/20##>", "<##.##>-<##.##>",
        "<##-###>", "<#### #### ##>", "<##.#####>", "<20##.##.##>",
    )),
    ("email_in_words", ("", "mail ", "write to ", "contact: "), tuple(f"<{u}{at}{host}>" for at in _WORD_AT for host in _WORD_HOSTS for u in _WORD_USERS) + tuple(f"<{u} at {host}>" for u in _WORD_USERS for host in ("?????? dot com", "???? dot co dot uk", "????? dot net", "?????? dot org"))),
    (None, ("", "then ", "we "), (
        "<look at ?????.?????????>", "<????? at #.#>", "<???? at ##.##>", "<?????? at ????.??>", "<???? at ???.????>", "<??? at ???????.?????>", "<arrived at ????.???? >", "<met at ?????.???>", "<???? at ##.##.20##>", "<???????? at ????????.?????>", "<sold at #.## >", "<?? at ?????.????????>",
    )),
    ("iban", ("", "iban ", "account ", "pay to ", "IBAN: "), _iban_shapes()),
    (None, ("", "part ", "serial ", "code ", "model ", "key "), (
        "<~~##~~~#~~#~>", "<~~##~#~##~#~>", "<~~####~~####>", "<~~## #### ####>", "<~~##~~~~~~~~>", "<~~##########>", "<~~## ~~~~ ####>", "<~~##~~##~~##>", "<~~##~~##~~##~~##>", "<~~## #~#~ ~#~#>", "<~~###########>", "<~~## ##~~ ##~~ ##~~>",
    )),
    ("ip6", ("", "host ", "address ", "from "), (
        "<20##:db^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^>", "<fe80::^^^^:^^^^:^^^^:^^^^>", "<20##:^^^^:^^^^::^^>", "<2a0#:^^^^:^^^^:^::^^>", "<fd##:^^^^:^^^^:^^^^::^^^^>", "<20##:^:^:^::^^^^>", "<20##:^^^^:^^^:^^::^^^>", "<26##:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^:^^^^>",
    )),
    (None, ("", "time ", "at ", "mac ", "row "), ("<##:##:##>", "<0#:##:##:##>", "<##:##:##:##>", "<^^:^^:^^:^^:^^:^^>", "<^^:^^:^^:^^:^^:^^:^^:^^>", "<#:##:##>", "<##:##:##:##:##>", "<##:#:##>", "<1#:##:##:###>", "<^^:^^:^^:^^>")),
)
#: Identity numbers have one shape, so it is leads that are known or unknown.
_ID_LEADS = (
    ("id_number", ("", "ssn ", "social security ", "ssn: ", "her social: ", "passport ", "client ", "the ssn of ", "ssn number ", "SSN # ", "social security number ", "passport no ", "his ssn is ", "ssn=", "social ", "client number ")),
    (None, ("part ", "item ", "order ", "$", "no. ", "lot ", "model ", "kit ", "id ", "serial ", "ref ", "invoice ", "room ", "sheet ", "#", "tracking ")),
)


#: Folds of shapes.
FOLDS = 4


def forms() -> list[tuple[str | None, str, str, str, int]]:
    """(kind, lead, span, tail, fold) of every form; all forms of a shape (of a lead, for identity numbers) are in one fold."""
    out = []
    for kind, leads, shapes in GRAMMAR:
        for i, shape in enumerate(shapes):
            before, _, rest = shape.partition("<")
            span, _, after = rest.partition(">")
            out += [(kind, lead + before, span, after.replace("<", "").replace(">", ""), i % FOLDS) for lead in leads]
    for kind, leads in _ID_LEADS:
        out += [(kind, lead, "###-##-####", "", i % FOLDS) for i, lead in enumerate(leads)]
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The check of a kind of the base."""
    digits = _digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) < 4) & F.forall(F.split(value, r"\."), lambda p: F.coalesce(F.right(p, F.lit(9)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(kind == "email")


def features(text: Column, span: Column) -> Column:
    """A candidate's ``FEATURES`` as an array of small numbers."""
    value = span["value"]
    before = F.when(span["start"] > 0, F.substring(text, F.greatest(span["start"] - 23, F.lit(1)), F.least(span["start"], F.lit(24)))).otherwise("")
    after = F.substring(text, span["end"] + 1, F.lit(1))
    digits = _digits(value)
    runs = F.transform(F.split(value, "[^0-9]+"), lambda r: F.length(r))
    filled = F.filter(runs, lambda n: n > 0)
    beside = lambda c, at: F.when(c.rlike(rf"[A-Za-z0-9_]{at}" if at == "$" else "^[A-Za-z0-9_]"), 2).when(c.rlike(rf"[#$%&*/=.:~+-]{at}" if at == "$" else r"^[#$%&*/=:~+-]"), 1).otherwise(0)
    separators = [F.when(value.rlike(p), 1 << i).otherwise(0) for i, p in enumerate((r"\x20", "-", r"\.", r"[/:()\[]"))]
    out = (
        F.length(digits), F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.array_max(runs), F.size(filled), F.size(F.array_distinct(F.split(digits, ""))),
        sum(separators, F.lit(0)), F.coalesce(F.substring(digits, 1, 1).try_cast("int"), F.lit(10)), beside(before, "$"), beside(after, "^"),
        before.rlike(_CUE).cast("int"), before.rlike(_NUMBER).cast("int"), F.length(_digits(before)),
        F.coalesce(F.get(filled, F.lit(0)), F.lit(0)), F.coalesce(F.try_element_at(filled, F.lit(-1)), F.lit(0)),
    )
    return F.array(*[F.least(x.cast("int"), F.lit(31)) for x in out])


@dataclass
class Model:
    """Boosted trees: (kind, f, a, g, b, values) adds values[2 * (x[f] > a) + (x[g] > b)]; a threshold per kind.

    ``report`` has the held-out (precision, recall) of each kind at its threshold, and its held-out candidates.
    """

    prior: dict[str, float] = field(default_factory=dict)
    trees: list[tuple[str, int, int, int, int, tuple[float, ...]]] = field(default_factory=list)
    thresholds: dict[str, float] = field(default_factory=dict)
    report: dict[str, tuple[float, float, int]] = field(default_factory=dict)

    def score(self, kind: str, x: np.ndarray) -> np.ndarray:
        """The scores of rows of features."""
        z = np.full(len(x), self.prior.get(kind, -9.0))
        for k, f, a, g, b, values in self.trees:
            if k == kind:
                z += np.array(values)[2 * (x[:, f] > a) + (x[:, g] > b)]
        return 1 / (1 + np.exp(-z))

    def sql(self, kind: str, x: Column) -> Column:
        z = F.lit(self.prior.get(kind, -9.0))
        for k, f, a, g, b, v in self.trees:
            if k == kind:
                high = F.when(x[g] > b, v[3]).otherwise(v[2])
                z = z + F.when(x[f] > a, high).otherwise(F.when(x[g] > b, v[1]).otherwise(v[0]))
        return 1 / (1 + F.exp(-z))


def fit(counts: list[tuple[str, list[int], bool, bool, int]], rounds: int = 25, rate: float = 0.4, precision: float = 0.95, least: int = 30) -> Model:
    """Boost on (kind, features, label, held out, count); held-out counts set the thresholds.

    A kind with fewer than ``least`` held-out candidates at any score adds nothing.
    """
    model = Model()
    for kind in sorted({c[0] for c in counts}):
        own = [c for c in counts if c[0] == kind]
        x, y, held, n = (np.array([c[i] for c in own]) for i in (1, 2, 3, 4))
        tx, ty, tn = x[~held], y[~held].astype(float), n[~held].astype(float)
        positive = float((tn * ty).sum())
        model.prior[kind] = float(np.log((positive + 1) / (tn.sum() - positive + 1)))
        cuts = [(f, int(a)) for f in range(len(FEATURES)) for a in np.unique(tx[:, f])[:-1]] if len(tx) else []
        sides = np.array([tx[:, f] > a for f, a in cuts], dtype=float).reshape(len(cuts), len(tx))
        z = np.full(len(tx), model.prior[kind])
        for _ in range(rounds if cuts else 0):
            p = 1 / (1 + np.exp(-z))
            slope, weight = tn * (ty - p), tn * p * (1 - p)
            leaf = lambda m: ((m @ slope) ** 2) / (m @ weight + 1)
            i = int(np.argmax(leaf(sides) + leaf(1 - sides)))
            inside, outside = sides[i] * sides, (1 - sides[i]) * sides
            rest_in, rest_out = sides[i] - inside, (1 - sides[i]) - outside
            j = int(np.argmax(leaf(inside) + leaf(rest_in) + leaf(outside) + leaf(rest_out)))
            where = (2 * sides[i] + sides[j]).astype(int)
            g, h = np.bincount(where, slope, 4), np.bincount(where, weight, 4) + 1
            values = tuple((rate * g / h).tolist())
            model.trees.append((kind, *cuts[i], *cuts[j], values))
            z = z + np.array(values)[where]
        model.thresholds[kind], figures = threshold(model.score(kind, x[held]), y[held], n[held], precision, least)
        if figures:
            model.report[kind] = figures
    return model


def threshold(score: np.ndarray, label: np.ndarray, n: np.ndarray, precision: float, least: int) -> tuple[float, tuple[float, float, int] | None]:
    """The lowest score, at least one half, from which the precision is sure, with (precision, recall, candidates) there; 2 if there is none."""
    if not len(score):
        return 2.0, None
    order = np.argsort(-score, kind="stable")
    score, good, some = score[order], (n * label)[order].cumsum(), n[order].cumsum()
    share = good / some
    sure = share - 2 * np.sqrt(np.maximum(share * (1 - share), 1 / some) / some) >= precision
    ends = np.append(score[1:] != score[:-1], True) & (some >= least) & sure & (score >= 0.5)
    if not ends.any():
        return 2.0, None
    last = int(np.flatnonzero(ends)[-1])
    return float(score[last]) - 1e-9, (float(share[last]), float(good[last] / max(good[-1], 1)), int(some[-1]))


def _located(kind: Kind, text: Column) -> Column:
    return located(text if kind.needs is None else F.when(F.contains(text, F.lit(kind.needs)), text), kind.pattern)


def _featured(kind: Kind, text: Column) -> Column:
    """Candidates of a kind as start, end and features ``x``."""
    return F.transform(_located(kind, text), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), features(text, s).alias("x")))


def _good(kind: Kind, text: Column) -> Column:
    """The candidates of a base kind that pass their check."""
    return F.filter(_located(kind, text), lambda s: passes(kind.name, s["value"]))


def planted(docs: DataFrame, contexts: int = 1500, each: int = 40) -> DataFrame:
    """(fold, kind, at, upto, text): about ``each`` of the ``forms`` in a place of ``contexts`` documents, all chosen by hash.

    The form's kind is null if it is no personal data; the span is at to upto.
    """
    known = forms()
    order = F.xxhash64("doc_id", F.length("text"))
    place = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.greatest(F.length("text"), F.lit(1))).cast("int")
    windows = docs.where(F.length("text") > 0).select(order.alias("h"), F.substring(F.col("text"), place + 1, F.lit(80)).alias("w"))
    # The sample is one partition of the least hashes; the work on it is dealt to all tasks.
    tasks = 2 * docs.sparkSession.sparkContext.defaultParallelism
    lent = windows.orderBy("h", "w").limit(contexts).repartition(tasks, "h", "w")
    made = docs.sparkSession.createDataFrame([(i, *f) for i, f in enumerate(known)], "i int, kind string, lead string, form string, tail string, fold int")
    chosen = F.filter(F.sequence(F.lit(0), F.lit(len(known) - 1)), lambda i: F.pmod(F.xxhash64("h", i, F.lit(2)), F.lit(max(1, len(known) // each))) == 0)
    rows = lent.select("h", "w", F.explode(chosen).alias("i")).join(F.broadcast(made), "i")

    def drawn(c: str, salt: int) -> Column:
        def one(x: Column, i: Column) -> Column:
            roll = lambda n: F.pmod(F.xxhash64("h", "i", i, F.lit(salt)), F.lit(n)).cast("int")
            of = lambda chars: F.substring(F.lit(chars), roll(len(chars)) + 1, F.lit(1))
            return F.when(x == "#", of("0123456789")).when(x == "^", of("0123456789abcdef")).when(x == "?", of("abcdefghijklmnopqrstuvwxyz")).when(x == "~", of("ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(x)

        return F.array_join(F.transform(F.split(c, ""), one), "")

    # Every other place lends only white space, so that lone values are known as well.
    half = F.when(F.col("h") % 2 == 0, F.col("w")).otherwise("")
    parts = rows.select("fold", "kind", F.concat(F.substring(half, 1, 40), F.lit(" "), drawn("lead", 1)).alias("left"), drawn("form", 2).alias("value"), F.concat(drawn("tail", 3), F.lit(" "), F.substring(half, 41, 40)).alias("right"))
    return parts.select("fold", "kind", F.length("left").alias("at"), (F.length("left") + F.length("value")).alias("upto"), F.concat("left", "value", "right").alias("text"))


def learn(docs: DataFrame, precision: float = 0.95, contexts: int = 1500, least: int = 30) -> Model:
    """Fit on the candidates over planted spans.

    Each fold of the forms is scored by trees that know the other folds only, and
    these scores set the thresholds, so they and the ``report`` are about forms that
    the trees have not seen.  The trees that are kept know all forms.
    """

    def over(kind: Kind) -> Column:
        met = F.filter(_featured(kind, F.col("text")), lambda s: (s["start"] < F.col("upto")) & (s["end"] > F.col("at")))
        return F.transform(met, lambda s: F.struct(F.lit(kind.name).alias("kind"), s["x"].alias("x")))

    told = [over(kind) for kind in KINDS if not kind.base]
    rows = planted(docs, contexts).select("fold", F.col("kind").alias("is"), F.explode(F.concat(*told)).alias("c")).where("is is null or is = c.kind")
    counts = rows.groupBy("c.kind", "c.x", F.col("is").isNotNull().alias("label"), "fold").count()
    cells = sorted((r[0], list(r[1]), bool(r[2]), r[3], r[4]) for r in counts.collect())
    apart: dict[str, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
    for fold in range(FOLDS):
        trained = fit([(k, x, y, False, n) for k, x, y, f, n in cells if f != fold])
        for kind in trained.prior:
            own = [(x, y, n) for k, x, y, f, n in cells if k == kind and f == fold]
            if own:
                x, y, n = (np.array(c) for c in zip(*own))
                apart.setdefault(kind, []).append((trained.score(kind, x), y, n))
    model = fit([(k, x, y, False, n) for k, x, y, _, n in cells])
    for kind, parts in apart.items():
        model.thresholds[kind], figures = threshold(*(np.concatenate(c) for c in zip(*parts)), precision, least)
        if figures:
            model.report[kind] = figures
    return model


def _apart(spans: Column) -> Column:
    """Of sorted spans that overlap, the one with the higher score (the earlier on ties)."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        rest = F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when((F.size(acc) == 0) | (last["end"] <= s["start"]), F.concat(acc, F.array(s))).when(last["score"] < s["score"], F.concat(rest, F.array(s))).otherwise(acc)

    return F.aggregate(spans, F.filter(spans, lambda s: F.lit(False)), step)


def find_personal_data(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, text, ``base`` and ``added``: sorted arrays of start, order, end and kind; added spans have their score."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    rows = rows.withColumn("base", F.array_sort(F.concat(*[with_kind(_good(k, text), k.name, i) for i, k in enumerate(KINDS) if k.base])))

    def added(i: int, kind: Kind) -> Column:
        free = F.filter(_featured(kind, text), lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"])))
        scored = F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("order"), s["end"].alias("end"), F.lit(kind.name).alias("kind"), model.sql(kind.name, s["x"]).alias("score")))
        return F.filter(scored, lambda s: s["score"] >= model.thresholds[kind.name])

    more = [added(i, k) for i, k in enumerate(KINDS) if not k.base and model.thresholds.get(k.name, 2.0) <= 1]
    nothing = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,score:double>>")
    return rows.select("doc_id", "text", "base", F.array_sort(F.concat(nothing, *more)).alias("raw")).select("doc_id", "text", "base", _apart(F.col("raw")).alias("added"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and text with every found span replaced by its kind in brackets."""
    found = find_personal_data(docs, model)
    plain = lambda c: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.array_sort(F.concat(F.col("base"), plain("added")))

    def step(acc: Column, s: Column) -> Column:
        return F.when(s["start"] < acc["at"], F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("out")))

    done = F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step)
    parts = found.select("doc_id", "text", done.alias("done"))
    return parts.select("doc_id", F.concat("done.out", F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))).alias("text"))


def personal_data_report(docs: DataFrame, precision: float = 0.95) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans, all spans, and the number of added ones, per row."""
    found = find_personal_data(docs, learn(docs, precision))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    plain = F.transform("added", lambda s: F.struct(s["start"].alias("start"), s["order"].alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base], F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.concat(F.col("base"), plain)).alias("spans"), F.size("added").cast("long").alias("n_added"))
