"""Personal data (operator 3), with DataFrame functions only.

Method: generators propose candidate spans, some of them loose and overlapping; boosted trees over features of the
format and of the characters around a span give each a score; a threshold for each kind, calibrated on rows the trees
have not seen, selects. Spans that a strict rule (base) accepts always stay; the model adds to them.

The trees are trained here, on labelled example texts that `examples` makes from patterns of contexts and formats; their
number is a parameter. Training collects only the distinct feature rows with their counts, which the features bound.

Positions: a pattern is applied twice, to extract its matches and to split the text at them. Both find the same leftmost
non-overlapping matches, so the lengths of the pieces and of the matches add up to starts and ends, in code points.

Long texts: arrays are walked in blocks of BLOCK, and a text is read at a place by way of its pages of PAGE code points, so the
work stays near to linear in the text and in its matches.

Defined cases: a null text has no spans (and stays null when redacted); repeated rows each get a row; an empty table gives an
empty result; columns of any name are kept.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
EXAMPLES = 6000
PRECISION = 0.97

# The strict rules. They equal the plain patterns of the contract; possessive repeats and the condition on the character
# before (the end of the last match or no character of the run) only keep the search linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a rule to accept any of its matches; spares most texts the extraction.
NEEDS = {
    "email": r"@[A-Za-z0-9-]++\.[A-Za-z0-9-]",
    "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
    "card": r"[0-9](?:[\x20-]?[0-9]){11}",
    "phone": r"\+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
# The loose generators: what people write beside the strict forms.
LOOSE = {
    "email": r"(?i)(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]\x20?(?:at|@)\x20?[\])}]\x20?[A-Za-z0-9-]++(?:(?:\x20?[\[({]?\x20?dot\x20?[\])}]?\x20?|\.)[A-Za-z0-9-]{2,63}+){1,4}",
    "ip": r"(?:\G|(?<![0-9A-Fa-f:]))(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"[0-9](?:[\x20._/-]{0,2}[0-9]){11,18}+",
    "phone": r"(?<![0-9])\(?[0-9]{2,4}\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3,5}(?![0-9])",
}
LOOSE_NEEDS = {
    "email": r"(?i)[\[({]\x20?(?:at|@)\x20?[\])}]",
    "ip": r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]{1,4}+:[0-9A-Fa-f]",
    "card": r"[0-9](?:[\x20._/-]{0,2}[0-9]){11}",
    "phone": r"[0-9]\)?[\x20./-]{1,2}[0-9]{3,4}[\x20./-][0-9]{3}",
}
WORDS = {
    "email": r"(?i)mail|contact|write|reach",
    "ip": r"(?i)\bip\b|host|server|address|client|from",
    "card": r"(?i)card|visa|credit|debit|payment|amex",
    "phone": r"(?i)phone|call|tel|mobile|cell|fax|contact",
}
AGAINST = r"(?i)isbn|order|ref|serial|version|build|id\b|token|sha|hash|invoice|part|time|date|mac\b|page"
FEATURES = ("kind", "strict", "digits", "seps", "luhn", "word", "against", "glued", "groups", "parens")
NO_SPANS = "array<struct<m:string,s:int,e:int>>"
#: Elements of a block of an array, code points of a page of a text.
BLOCK = 128
PAGE = 4096


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def accepts(kind: str, m: Column) -> Column:
    """Whether the strict rule keeps a match of its pattern."""
    n = F.length(_digits(m))
    return {
        "email": lambda: F.lit(True),
        "ip": lambda: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda: n.between(12, 19) & F.call_function("luhn_check", _digits(m)),
        "phone": lambda: n.between(9, 15),
    }[kind]()


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once, however often the body's own loops name it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array of at least one element as an array of arrays of BLOCK elements."""
    return _let(items, lambda x: F.transform(F.sequence(F.lit(0), F.ceil(F.size(x) / BLOCK).cast("int") - 1), lambda k: F.slice(x, k * BLOCK + 1, BLOCK)))


def _before(values: Column, zero: Column, add) -> Column:
    """For each element the sum (by add) of all before it."""
    return _let(values, lambda v: F.transform(v, lambda _, i: F.aggregate(F.slice(v, 1, i), zero, add)))


def _located(matches: Column, pieces: Column) -> Column:
    """Array of (m, s, e): each match with its start and end, from the pieces between matches. For at least one match."""

    def step(a: Column, x: Column) -> Column:
        s = a["at"] + x["p"]
        e = s + F.length(x["m"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(x["m"].alias("m"), s.alias("s"), e.alias("e")))).alias("out"))

    def place(block: Column, start: Column) -> Column:
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast(NO_SPANS).alias("out")), step)["out"]

    both = F.zip_with(matches, F.slice(pieces, 1, F.size(matches)), lambda m, p: F.struct(m.alias("m"), F.length(p).alias("p")))
    sizes = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + x["p"] + F.length(x["m"])))
    return _let(_blocks(both), lambda blocks: F.flatten(F.zip_with(blocks, _before(sizes(blocks), F.lit(0), lambda a, x: a + x), place)))


def _pages(t: Column) -> Column:
    """A text's pages; reading at a place counts code points from the start of a page, not of the text."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.length(t) / PAGE).cast("int")), lambda k: F.substring(t, k * PAGE + 1, F.lit(PAGE)))


def _read(pages: Column, start: Column, size: Column) -> Column:
    """`size` code points from `start` (counted from 0)."""
    first = F.floor(start / PAGE).cast("int")
    some = F.array_join(F.slice(pages, first + 1, F.floor((start + size) / PAGE).cast("int") - first + 1), "")
    return F.substring(some, start - first * PAGE + 1, size)


def _spans(docs: DataFrame, patterns: dict[str, str], needs: dict[str, str], prefix: str) -> DataFrame:
    """Adds, for each kind, the column prefix + kind: the spans of its pattern in the column t."""
    kinds = list(patterns)
    # Three steps, so that each array is computed once for each row.
    out = docs.withColumns({f"{prefix}{k}": F.when(F.col("t").rlike(needs[k]), F.regexp_extract_all("t", F.lit(patterns[k]), 0)).otherwise(F.array().cast("array<string>")) for k in kinds})
    out = out.withColumns({f"{prefix}{k}_": F.when(F.size(f"{prefix}{k}") > 0, F.split("t", patterns[k], -1)).otherwise(F.array().cast("array<string>")) for k in kinds})
    out = out.withColumns({f"{prefix}{k}": F.when(F.size(f"{prefix}{k}") > 0, _located(F.col(f"{prefix}{k}"), F.col(f"{prefix}{k}_"))).otherwise(F.array().cast(NO_SPANS)) for k in kinds})
    return out.drop(*(f"{prefix}{k}_" for k in kinds))


def _features(kind: str, x: Column, pages: Column) -> Column:
    """The features of span x of a text as a struct of small ints, in the order of FEATURES."""
    left = _read(pages, F.greatest(F.lit(0), x["s"] - 24), F.least(F.lit(24), x["s"]))
    right = _read(pages, x["e"], F.lit(1))
    digits = _digits(x["m"])
    as_int = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    tidy = {"email": r"\.[A-Za-z]{2,6}$|dot\x20?[\])}]?\x20?[A-Za-z]{2,6}$", "ip": r"^(?:[0-9A-Fa-f]{3,4}:|[0-9.]+$)", "card": r"^(?:[0-9]{4}[\x20._/-]){3}[0-9]{4}$|^[0-9]{16}$", "phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}$"}[kind]
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        as_int(accepts(kind, x["m"]) & x["m"].rlike(f"^(?:{BASE[kind]})$")).alias("strict"),
        F.least(F.length(digits), F.lit(20)).alias("digits"),
        F.least(F.length(F.regexp_replace(x["m"], r"[^\x20._/:-]", "")), F.lit(8)).alias("seps"),
        as_int((F.length(digits) >= 12) & F.call_function("luhn_check", digits)).alias("luhn"),
        as_int(left.rlike(WORDS[kind])).alias("word"),
        as_int(left.rlike(AGAINST)).alias("against"),
        as_int(left.rlike(r"[\p{L}\p{N}_=/.\"'#:-]$") | right.rlike(r"^[\p{L}\p{N}_/\"'#]")).alias("glued"),
        as_int(x["m"].rlike(tidy)).alias("groups"),
        as_int(x["m"].rlike(r"[()\[\]{}+]")).alias("parens"),
    )


def _accepted(kind: str):
    return lambda x: accepts(kind, x["m"])


def _placed(i: int):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("k"), x["e"].alias("e"))


def _featured(kind: str):
    return lambda x: _features(kind, x, F.col("pages"))


def _candidate(kind: str):
    return lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), _features(kind, x, F.col("pages")).alias("x"))


def _is_kind(i: int):
    return lambda x: x["k"] == i


def _candidates(docs: DataFrame) -> DataFrame:
    """docs with the columns b_<kind> (accepted by the strict rule) and l_<kind> (loose, those within a strict one left out)."""
    out = _spans(_spans(docs, BASE, NEEDS, "b_"), LOOSE, LOOSE_NEEDS, "l_")
    out = out.withColumns({f"b_{k}": F.filter(f"b_{k}", _accepted(k)) for k in KINDS})
    out = out.withColumn("base", F.concat(*(F.transform(f"b_{k}", _placed(i)) for i, k in enumerate(KINDS))))
    # Strict spans in blocks by start, each with the range that it covers: a loose one looks only into blocks that it meets.
    ranged = F.transform(_blocks(F.array_sort("base")), lambda b: F.struct(F.get(b, F.lit(0))["s"].alias("s"), F.aggregate(b, F.lit(0), lambda a, x: F.greatest(a, x["e"])).alias("e"), b.alias("b")))
    loose = F.size(F.concat(*(f"l_{k}" for k in KINDS))) > 0
    out = out.withColumn("strict", F.when(loose & (F.size("base") > 0), ranged))
    meets = lambda b, x: (b["s"] < x["e"]) & (x["s"] < b["e"])
    free = lambda x: ~F.exists("strict", lambda r: F.when(meets(r, x), F.exists(r["b"], lambda b: meets(b, x))).otherwise(False))
    out = out.withColumns({f"l_{k}": F.when(F.col("strict").isNotNull(), F.filter(f"l_{k}", free)).otherwise(F.col(f"l_{k}")) for k in KINDS})
    return out.drop("strict").withColumn("pages", F.when(loose, _pages(F.col("t"))))


@dataclass
class Boosted:
    """Boosted trees on feature structs whose sum is a log-odds score; thresholds: least probability, by kind.

    A tree asks the same questions along each level, (feature, bound) pairs, and has a leaf for each pattern of answers. So the
    forest is a table, and its score one small expression over that table.
    """

    bias: float = 0.0
    trees: list[tuple[list[tuple[int, int]], list[float]]] = field(default_factory=list)
    thresholds: dict = field(default_factory=dict)

    def value(self, row: tuple) -> float:
        return self.bias + sum(leaves[_leaf(row, asked)] for asked, leaves in self.trees)

    def column(self, x: Column) -> Column:
        """The probability as a column expression over a feature struct."""
        if not self.trees:
            return F.lit(1 / (1 + math.exp(-self.bias)))
        row = F.array(*(x[f] for f in FEATURES))
        table = F.array(*(F.struct(F.array(*(F.lit(f) for f, _ in asked)).alias("f"), F.array(*(F.lit(at) for _, at in asked)).alias("at"), F.array(*map(F.lit, leaves)).alias("leaves")) for asked, leaves in self.trees))

        def score(z: Column, tree: Column) -> Column:
            leaf = F.aggregate(F.arrays_zip(tree["f"].alias("f"), tree["at"].alias("at")), F.lit(0), lambda n, q: n * 2 + (F.get(row, q["f"]) >= q["at"]).cast("int"))
            return z + F.get(tree["leaves"], leaf)

        return F.aggregate(table, F.lit(float(self.bias)), score, lambda z: F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))


def _leaf(row: tuple, asked: list[tuple[int, int]]) -> int:
    n = 0
    for f, at in asked:
        n = n * 2 + (row[f] >= at)
    return n


def _tree(rows: list, depth: int, rate: float) -> tuple[list[tuple[int, int]], list[float]]:
    """Fit one tree to (features, gradient, hessian) rows: each level the question with the greatest gain over all leaves."""
    asked: list[tuple[int, int]] = []
    for _ in range(depth):
        best, gain = None, 1e-3
        for f in range(len(FEATURES)):
            for at in sorted({r[0][f] for r in rows})[1:]:
                sums: dict[tuple[int, bool], list[float]] = defaultdict(lambda: [0.0, 0.0])
                for x, g, h in rows:
                    one = sums[_leaf(x, asked), x[f] >= at]
                    one[0] += g
                    one[1] += h
                new = sum(g * g / (h + 1) for g, h in sums.values())
                if new > gain + 1e-9:
                    best, gain = (f, at), new
        if best is None or best in asked:
            break
        asked.append(best)
    sums = defaultdict(lambda: [0.0, 0.0])
    for x, g, h in rows:
        one = sums[_leaf(x, asked)]
        one[0] += g
        one[1] += h
    return asked, [-rate * sums[k][0] / (sums[k][1] + 1) if k in sums else 0.0 for k in range(1 << len(asked))]


def boost(counts: list[tuple[tuple, int, int]], rounds: int = 30, depth: int = 3, rate: float = 0.3) -> Boosted:
    """Gradient boosting for log loss on distinct feature rows (features, rows, rows with label 1)."""
    n, ones = sum(c[1] for c in counts), sum(c[2] for c in counts)
    share = min(max(ones / n if n else 0.5, 1e-3), 1 - 1e-3)
    model = Boosted(math.log(share / (1 - share)))
    z = [model.bias] * len(counts)
    for _ in range(rounds if n else 0):
        p = [1 / (1 + math.exp(-v)) for v in z]
        tree = _tree([(x, k * q - y, max(k * q * (1 - q), 1e-6)) for (x, k, y), q in zip(counts, p, strict=True)], depth, rate)
        model.trees.append(tree)
        z = [v + tree[1][_leaf(x, tree[0])] for v, (x, _, _) in zip(z, counts, strict=True)]
    return model


def calibrate(model: Boosted, counts: list[tuple[tuple, int, int]], precision: float = PRECISION) -> None:
    """Set each kind's threshold: the lowest score at which the rows from it up reach the precision; none: above 1."""
    for i, kind in enumerate(KINDS):
        rows = sorted(((1 / (1 + math.exp(-model.value(x))), k, y) for x, k, y in counts if x[0] == i), reverse=True)
        model.thresholds[kind], n, ones = 1.1, 0, 0
        for j, (p, k, y) in enumerate(rows):
            n, ones = n + k, ones + y
            if ones >= precision * n and (j + 1 == len(rows) or rows[j + 1][0] < p):
                model.thresholds[kind] = max(p - 1e-9, 0.5)


def examples(spark: SparkSession, rows: int = EXAMPLES) -> DataFrame:
    """(id, t, y): labelled texts, each around one span; y is 1 if the span is personal data. Always the same rows."""
    near = {"email": ["mail me: ", "contact ", "write to "], "ip": ["from ip ", "server address ", "client "], "card": ["credit card ", "visa ", "payment by card "], "phone": ["call ", "phone: ", "fax "]}
    far = ["isbn ", "order ", "serial ", "version ", "build ", "part ", "page ", "token=", "ref:"]
    plain = ["and then the ", "in that ", "it was "]
    # '#': a random digit, '@': a random letter, '%': a random hex digit.
    good = {"email": ["@@@.@@ (at) @@@@@ dot com", "@@@@[at]@@@@@.org", "@@@ {at} @@@@ {dot} net"], "ip": ["%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%:%%%%", "%%%%:%%%:%%%%:%%%%"], "card": ["####.####.####.####", "####_####_####_####"], "phone": ["(###) ###-####", "###-###-####", "###.###.####", "0## #### ####"]}
    bad = {"email": ["@@ (at) ## . ##", "@ [at] ##dot##"], "ip": ["##:##:##:##", "%%:%%:%%:%%:%%:%%", "#:#:#:#"], "card": ["###############", "##.##.##.##.##.##.##", "#################"], "phone": ["##/###/####", "####.####.####", "### #### #####", "## ### ###"]}
    made = []
    for k in KINDS:
        for shape in good[k]:
            made += [(c, shape, 1, "") for c in near[k] * 3 + plain] + [(c, shape, int(k == "email"), "") for c in far[:7]] + [(c, shape, 0, "x9") for c in far[7:]]
        for shape in bad[k]:
            made += [(c, shape, int(k == "card" and "###############" in shape and c in near[k]), "") for c in plain * 2 + far + near[k]]
        made += [(c, {"email": "@@@@@.##@mail.example.com", "ip": "1##.1##.##.##", "card": "################", "phone": "+1 (###) 555-####"}[k], int(k != "card"), "") for c in plain + near[k]]
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(s).alias("m"), F.lit(y).alias("y"), F.lit(r).alias("r")) for c, s, y, r in made))
    picked = spark.range(rows).select("id", table[(F.col("id") % len(made)).cast("int")].alias("x"))
    filled = F.array_join(
        F.transform(
            F.split("x.m", ""),
            lambda c, i: F.when(c == "#", F.pmod(F.xxhash64("id", i), F.lit(10)).cast("string")).when(c == "@", F.substring(F.lit("bcdfghjklmnpqrstvwxyz"), (F.pmod(F.xxhash64("id", i), F.lit(21)) + 1).cast("int"), F.lit(1))).when(c == "%", F.lower(F.hex(F.pmod(F.xxhash64("id", i), F.lit(16))))).otherwise(c),
        ),
        "",
    )
    # The shape of a strict e-mail has an '@' of its own; its letters come from the same letters, so it is written last.
    mail = F.when(F.col("x.m").contains("mail.example"), F.concat(F.regexp_replace(F.substring(filled, 1, 8), "[^a-z0-9.]", "a"), F.lit("@mail.example.com"))).otherwise(filled)
    return picked.select("id", F.concat("x.c", mail, "x.r", F.lit(" for now")).alias("t"), F.col("x.y").alias("y"))


def train(spark: SparkSession, rows: int = EXAMPLES) -> Boosted:
    """Fit the trees on three quarters of the examples and the thresholds on the rest."""
    found = _candidates(examples(spark, rows)).withColumn("pages", _pages(F.col("t")))
    each = F.concat(*(F.transform(f"{p}_{k}", _featured(k)) for k in KINDS for p in ("b", "l")))
    counts = found.select((F.col("id") % 4 == 3).alias("held"), "y", F.explode(each).alias("x")).groupBy("held", "x").agg(F.count("*").alias("n"), F.sum("y").alias("ones")).orderBy("held", "x").collect()
    split = {h: [(tuple(r["x"]), r["n"], r["ones"]) for r in counts if r["held"] == h] for h in (False, True)}
    model = boost(split[False])
    calibrate(model, split[True])
    return model


def find_spans(docs: DataFrame, model: Boosted | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep_0, keep_1, ... (the columns keep), t (the text, null as empty), base and spans: arrays of (s, k, e) by start and kind.

    k is a place in KINDS. base holds what the strict rules accept; spans adds what the model selects, none of which
    overlaps a base span.
    """
    model = model or train(docs.sparkSession)
    rows = docs.select(*(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = _candidates(rows)

    each = F.concat(*(F.transform(f"l_{k}", _candidate(k)) for k in KINDS))
    found = found.withColumn("loose", F.when(F.size(F.concat(*(f"l_{k}" for k in KINDS))) > 0, each))
    least = F.array(*(F.lit(float(model.thresholds[k])) for k in KINDS))
    passed = F.filter("loose", lambda c: model.column(c["x"]) >= F.get(least, c["k"]))
    chosen = F.coalesce(F.transform(passed, lambda c: F.struct(c["s"].alias("s"), c["k"].alias("k"), c["e"].alias("e"))), F.array().cast("array<struct<s:int,k:int,e:int>>"))
    return found.select(*(f"keep_{i}" for i in range(len(keep))), "t", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", chosen)).alias("spans"))


def _listed(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def pii_digests(docs: DataFrame, model: Boosted | None = None) -> DataFrame:
    """doc_id, n_<kind> of the base, base_sha256, spans of every document."""
    found = find_spans(docs, model)
    return found.select(F.col("keep_0").alias("doc_id"), *(F.size(F.filter("base", _is_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def redact(docs: DataFrame, model: Boosted | None = None, text: str = "text") -> DataFrame:
    """The documents with each span replaced by its kind in brackets, all columns kept; a null text stays null.

    Spans that overlap are replaced together, by the kind of the first.
    """
    names = docs.columns
    found = find_spans(docs, model, text, tuple(names)).withColumn("pages", F.when(F.size("spans") > 0, _pages(F.col("t"))))
    tags = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))

    def step(a: Column, x: Column) -> Column:
        inside = x["s"] < a["at"]
        new = F.concat(a["out"], F.array(_read(F.col("pages"), a["at"], x["s"] - a["at"]), tags[x["k"]]))
        return F.struct(F.greatest(a["at"], x["e"]).alias("at"), F.when(inside, a["out"]).otherwise(new).alias("out"))

    def written(block: Column, start: Column) -> Column:
        return F.array_join(F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<string>").alias("out")), step)["out"], "")

    ends = lambda blocks: F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda a, x: F.greatest(a, x["e"])))
    done = _let(_blocks(F.col("spans")), lambda blocks: F.array_join(F.zip_with(blocks, _before(ends(blocks), F.lit(0), lambda a, x: F.greatest(a, x)), written), ""))
    last = F.array_max(F.transform("spans", lambda x: x["e"]))
    plain = F.concat(done, _read(F.col("pages"), last, F.length("t") - last))
    whole = F.when(F.size("spans") > 0, plain).otherwise(F.col(f"keep_{names.index(text)}"))
    return found.select(*(whole.alias(c) if c == text else F.col(f"keep_{i}").alias(c) for i, c in enumerate(names)))
