"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation estimates their accuracies.

All of it is DataFrame expressions. A document's texts become a few counts in one pass; the counts are written once,
each rule turns them into a vote (1 good, 0 bad, null abstains), equal patterns of votes are counted, and the model
is fitted on these patterns: at most 3**rules rows, whatever the size of the corpus.

The model: a document is good with probability `prior`; given good or bad, each rule votes 1, votes 0 or abstains
independently, with probabilities that EM estimates for every rule and class. Only a rule's direction is given
(which class it speaks for); that keeps the two classes apart. The posterior is the chance that a document is good.

Edge cases: null texts have no words; a text without words fails the base rules; an empty table keeps the starting
estimates; repeated or null doc_ids stay apart as rows; other columns are ignored. White space is \\x20, \\x09-\\x0D.
"""

from __future__ import annotations

import re
from math import fsum, prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.llm.common import SPACE_CLASS, materialize

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

#: The counts that the contract names, and those that only the rules use.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_doubled", "n_shouts", "n_capitals"]

#: Rule: SQL over the counts that is 1 for good, 0 for bad and null to abstain. A fault's absence is no merit: rules
#: that look for one kind of fault abstain where they find none, and others vote for ordinary prose.
RULES: dict[str, str] = {
    "symbol_words": "CASE WHEN 10 * n_symbols > n_words THEN 0 END",
    "symbol_chars": "CASE WHEN 50 * n_symbols > word_chars THEN 0 END",
    "repeats": "CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 0 END",
    "doubled": "CASE WHEN 100 * n_doubled > 30 * n_words THEN 0 END",
    "shouting": "CASE WHEN 10 * n_shouts > n_words THEN 0 END",
    "capitals": "CASE WHEN n_words >= 20 AND 100 * n_capitals > 30 * n_words THEN 0 END",
    "lines": "CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines THEN 0 END",
    "plain": "CASE WHEN 100 * n_symbols <= n_words AND 100 * n_shouts <= n_words AND 50 * n_capitals <= n_words THEN 1 END",
    "varied": "CASE WHEN 20 * n_doubled <= n_words AND 5 * n_repeat_words <= n_words THEN 1 END",
    "lengths": "CASE WHEN word_chars > 20 * n_words THEN 0 WHEN word_chars BETWEEN 3 * n_words AND 9 * n_words THEN 1 END",
}
ITERATIONS = 10
#: Where EM begins: the share of good documents, and how often a rule votes 1 and 0 on good and on bad ones.
START = {"prior": 0.8, "g1": 0.6, "g0": 0.01, "b1": 0.3, "b0": 0.4}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda's argument is bound, not repeated."""
    return F.element_at(F.transform(F.array(value), body), 1)


def counts(docs: DataFrame, text: str = "text", key: Column | None = None) -> DataFrame:
    """key (named key; doc_id if none is given) and the counts of each whole text: COUNTS and MORE.

    Windows of three words are first compared by their hashes, of which all bits but those that number the text's
    words are kept (49 at 20,000 words): sorted with their places in the low bits, equal windows stand side by side.
    The windows that this finds are then sorted and compared by their words.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    name = "doc_id" if key is None else "key"
    rows = docs.select((F.col("doc_id").cast("long") if key is None else key).alias(name), body.alias("body"))
    rows = rows.select(
        name,
        F.split(F.btrim("body", F.lit(BLANKS)), SPACE_CLASS).alias("words"),
        F.filter(F.split("body", "\n"), lambda x: x.rlike(r"\S")).alias("lines"),
        F.regexp_count("body", F.lit("[" + re.escape(SYMBOLS) + "]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("[A-Z]{3,}")).cast("long").alias("n_capitals"),
        (F.octet_length("body") - F.octet_length(F.replace("body", F.lit("!"), F.lit("")))).cast("long").alias("n_shouts"),
    )
    none = F.element_at("words", 1) == ""
    rows = rows.select(
        name, "n_symbols", "n_capitals", "n_shouts", "words",
        F.when(none, F.lit(0)).otherwise(F.size("words")).alias("n"),
        F.size(F.filter("words", lambda x, i: x == F.get("words", i - 1))).cast("long").alias("n_doubled"),
        F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w)).cast("long").alias("word_chars"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    bits = F.coalesce(F.ceil(F.log2(F.col("n") + 1)).cast("int"), F.lit(1))
    kept = [x for x in rows.columns if x not in ("n", "h")]
    rows = rows.select(*kept, F.col("n"), bits.alias("bits"), "h")
    cut = lambda x: F.call_function("shiftright", x, F.col("bits"))
    window = lambda x, i: F.call_function("shiftleft", cut(F.xxhash64(x, F.get("h", i + 1), F.get("h", i + 2))), F.col("bits")).bitwiseOR(i.cast("long"))
    windows = F.sort_array(F.transform(F.slice("h", F.lit(1), F.greatest(F.col("n") - 2, F.lit(0))), window))
    rows = rows.select(*kept, "n", "bits", windows.alias("w"))
    twin = lambda x, i: (cut(x) == cut(F.get("w", i - 1))) | (cut(x) == cut(F.get("w", i + 1)))
    place = lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1).cast("int")
    rows = rows.select(*kept, "n", F.transform(F.filter("w", twin), place).alias("p"))
    own = lambda i: F.struct(*(F.get("words", i + k).alias(f"w{k}") for k in range(3)), i.cast("long").alias("i"))
    rows = rows.select(*kept, "n", F.sort_array(F.transform("p", own)).alias("w"))
    kept.remove("words")
    same = lambda x, y: (x["w0"] == y["w0"]) & (x["w1"] == y["w1"]) & (x["w2"] == y["w2"])
    alike = F.filter("w", lambda x, i: same(x, F.get("w", i - 1)) | same(x, F.get("w", i + 1)))
    rows = rows.select(*kept, "n", F.sort_array(F.transform(alike, lambda x: x["i"])).alias("p"))
    covered = F.aggregate("p", F.struct(F.lit(-3).cast("long").alias("last"), F.lit(0).cast("long").alias("n")), lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(i - a["last"], F.lit(3))).alias("n")))
    return rows.select(name, F.col("n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", covered["n"].alias("n_repeat_words"), *MORE)


def _likelihood(votes: dict[str, str], share: float, rates: dict[str, tuple[float, float]]) -> Column:
    out = F.lit(share)
    for rule, v in votes.items():
        yes, no = rates[rule]
        out = out * F.when(F.col(v) == 1, F.lit(yes)).when(F.col(v) == 0, F.lit(no)).otherwise(F.lit(1 - yes - no))
    return out


class LabelModel:
    """Rates of the rules' votes by class; fit() counts the patterns of votes in one job and runs EM over them."""

    def __init__(self, rules: dict[str, str] = RULES):
        self.rules, self.votes = rules, {r: f"v_{r}" for r in rules}
        self.prior = START["prior"]
        self.good = dict.fromkeys(rules, (START["g1"], START["g0"]))
        self.bad = dict.fromkeys(rules, (START["b1"], START["b0"]))

    def vote(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", *(F.expr(sql).cast("int").alias(self.votes[r]) for r, sql in self.rules.items()))

    def posterior(self) -> Column:
        g, b = _likelihood(self.votes, self.prior, self.good), _likelihood(self.votes, 1 - self.prior, self.bad)
        return g / (g + b)

    def fit(self, voted: DataFrame, iterations: int = ITERATIONS) -> LabelModel:
        # At most 3**rules rows, whatever the size of the corpus.
        patterns = [(row["n"], [row[v] for v in self.votes.values()]) for row in voted.groupBy(*self.votes.values()).agg(F.count("*").alias("n")).collect()]
        total = sum(n for n, _ in patterns)
        for _ in range(iterations if total else 0):
            chance = lambda votes, share, rates: prod((y if v == 1 else n if v == 0 else 1 - y - n for v, (y, n) in zip(votes, rates.values(), strict=True)), start=share)
            weighed = []
            for n, votes in patterns:
                g, b = chance(votes, self.prior, self.good), chance(votes, 1 - self.prior, self.bad)
                weighed.append((n, n * g / (g + b), votes))
            good = fsum(g for _, g, _ in weighed)
            bad = total - good
            self.prior = min(0.99, max(0.01, (good + 1) / (total + 2)))
            for j, r in enumerate(self.rules):  # one vote of each kind more, so that no rate is 0 or 1
                of = {k: (fsum(g for _, g, v in weighed if v[j] == k), sum(n for n, _, v in weighed if v[j] == k)) for k in (1, 0)}
                self.good[r] = tuple((of[k][0] + 1) / (good + 3) for k in (1, 0))
                self.bad[r] = tuple((of[k][1] - of[k][0] + 1) / (bad + 3) for k in (1, 0))
        return self


BASE_FAILED = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def judge(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The columns of op9's contract, then posterior: the chance that the rules' votes give a document to be good.

    kept is false where the base rules fail and otherwise says whether the posterior reaches the threshold.
    """
    rows = materialize(counts(docs, text), "counts")
    model = LabelModel()
    voted = model.vote(rows)
    model.fit(voted)
    failed = F.expr(BASE_FAILED)
    return voted.select("doc_id", *COUNTS, failed.alias("base_failed"), (~failed & (model.posterior() >= threshold)).alias("kept"), F.round(model.posterior(), 6).alias("posterior"))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of docs that the method keeps, with all their columns; each row is judged by its own text."""
    rows = materialize(counts(docs, text, F.struct(*(F.col(f"`{c}`") for c in docs.columns))), "judged")
    model = LabelModel()
    voted = model.vote(rows)
    model.fit(voted)
    return voted.where(~F.expr(BASE_FAILED) & (model.posterior() >= threshold)).select("key.*")


def sql(iterations: int = ITERATIONS) -> str:
    """judge() in DuckDB SQL: the same counts, rules and EM steps, a common table expression for each step."""
    tests = [f"{condition} AS v_{name}" for name, condition in RULES.items()]
    votes = [f"v_{name}" for name in RULES]
    space = r"[\x20\x09-\x0D]+"
    symbols = "[" + re.escape(SYMBOLS) + "]"
    parts = [
        f"""d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t FROM documents),
        w AS (SELECT doc_id, r, t, list_filter(regexp_split_to_array(t, '{space}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
        p AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w),
        g AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM p),
        h AS (SELECT r, count(*) AS n FROM (SELECT DISTINCT r, unnest([i, i + 1, i + 2]) AS i FROM g WHERE n > 1) GROUP BY r),
        c AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '{symbols}')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(h.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(l) AS BIGINT) AS n_lines,
            CAST(len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS BIGINT) AS n_doubled, CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_shouts, CAST(len(regexp_extract_all(t, '[A-Z]{{3,}}')) AS BIGINT) AS n_capitals
            FROM w LEFT JOIN h USING (r)),
        v AS MATERIALIZED (SELECT *, {", ".join(tests)} FROM c),
        q AS MATERIALIZED (SELECT {", ".join(votes)}, count(*) AS n FROM v GROUP BY ALL)"""
    ]
    start = [f"{START['prior']}::DOUBLE AS prior"] + [f"{START[k]}::DOUBLE AS {k}_{r}" for r in RULES for k in ("g1", "g0", "b1", "b0")]
    parts.append(f"m0 AS (SELECT {', '.join(start)})")

    def posterior() -> str:
        def chance(c: str) -> str:
            return " * ".join(f"CASE v_{r} WHEN 1 THEN {c}1_{r} WHEN 0 THEN {c}0_{r} ELSE 1 - {c}1_{r} - {c}0_{r} END" for r in RULES)

        return f"(prior * {chance('g')}) / (prior * {chance('g')} + (1 - prior) * {chance('b')})"

    for k in range(iterations):
        sums = ["sum(n) AS a", "sum(n * p) AS g"]
        for r in RULES:
            for y in (1, 0):
                sums += [f"coalesce(sum(n * p) FILTER (v_{r} = {y}), 0) AS s{y}_{r}", f"coalesce(sum(n) FILTER (v_{r} = {y}), 0) AS t{y}_{r}"]
        rates = ["least(0.99, greatest(0.01, (g + 1) / (a + 2))) AS prior"]
        for r in RULES:
            rates += [f"(s{y}_{r} + 1) / (g + 3) AS g{y}_{r}, (t{y}_{r} - s{y}_{r} + 1) / (a - g + 3) AS b{y}_{r}" for y in (1, 0)]
        parts.append(f"m{k + 1} AS MATERIALIZED (SELECT {', '.join(rates)} FROM (SELECT {', '.join(sums)} FROM (SELECT q.*, {posterior()} AS p FROM q, m{k})))")
    failed = f"({BASE_FAILED})"
    out = f"SELECT doc_id, {', '.join(COUNTS)}, {failed} AS base_failed, NOT {failed} AND {posterior()} >= 0.5 AS kept, round({posterior()}, 6) AS posterior FROM v, m{iterations}"
    return "WITH " + ", ".join(parts) + " " + out
