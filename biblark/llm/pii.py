"""Personal data in whole texts, by weak supervision.

Method: four base patterns (email, ip, card, phone) give the base spans, which
always stay. Further candidates (secrets after a key word, written-out e-mail
addresses, account and identity numbers, names after a title or a greeting)
come from wide patterns. Labelers of three sorts vote on each: a strict regular
expression (for or against), a gazetteer and words in the context to its left
(for, or no vote). None of them reads what the wide pattern itself demands. The
counts of all vote patterns, over all documents, go to expectation-maximisation,
which estimates each labeler's reliability, kind by kind; its posteriors train a
logistic span classifier on kind, shape and context features, again from counts
over all documents. Both kinds of counts are bounded by the number of distinct
patterns, whatever the corpus. Candidates from ``THRESHOLD`` on are added as
spans.

Positions count code points; ends are exclusive. Defined results: a null or
empty text has no spans; a candidate that overlaps a base span is dropped;
repeated rows are read one by one; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from biblark.llm.common import Scratch, table

KINDS = ("email", "ip", "card", "phone")
THRESHOLD = 0.5
LEFT = 40

# The four patterns as they are fixed. The address pattern is searched from its @ (a run of local characters
# ends there and cannot hold another @), and digits are taken whole, so that long runs cost linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Wide patterns of the candidates, by kind.
WIDE = {
    "secret": re.compile(r"""(?i)\b(?:api[_-]?key|secret|token|passw(?:or)?d|pwd)\b["']?\s{0,4}[:=]\s{0,4}["']?([A-Za-z0-9_/+=.-]{8,})"""),
    "email_text": re.compile(r"(?i)\b([a-z0-9][a-z0-9._-]{0,63}\s?[\[(]?(?:\bat\b|@)[\])]?\s?[a-z0-9-]{2,63}\s?[\[(]?(?:\bdot\b|\.)[\])]?\s?(?:com|org|net|edu|io|de|fr|es|info))\b"),
    "account": re.compile(r"\b([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?)\b"),
    "identity": re.compile(r"(?<![0-9-])([0-9]{3}-[0-9]{2}-[0-9]{4})(?![0-9-])"),
    "name": re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\.?\x20([A-ZÀ-Þ][a-zß-ÿ]+(?:\x20[A-ZÀ-Þ][a-zß-ÿ]+)?)"),
}
# Cheap signs without which a wide pattern is not tried; plain substrings of the lower-case text, or a search that starts at a digit.
HINT = {
    "secret": ("key", "secret", "token", "passw", "pwd"),
    "email_text": (" dot ", "[dot]", "(dot)", "[at]", "(at)", "[@]", "(@)"),
    "account": re.compile(r"[0-9]{2}\x20?[A-Z0-9]{4}"),
    "identity": re.compile(r"[0-9]-[0-9]{2}-[0-9]"),
    "name": ("mr", "ms", "dr", "prof", "herr", "frau", "madame", "monsieur", "señor"),
}

STRICT = {
    "secret": re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_/+=.-]{16,}"),
    "email_text": re.compile(r"(?i)[a-z0-9._-]+\s?[\[(]?(?:at|@)[\])]?\s?[a-z0-9-]+\s?[\[(]?(?:dot|\.)[\])]?\s?[a-z]+"),
    "account": re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9\x20]{11,36}"),
    "identity": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "name": re.compile(r"[A-ZÀ-Þ][a-zß-ÿ]{2,}\x20[A-ZÀ-Þ][a-zß-ÿ]{2,}"),
}
# Beginnings of published token formats, mail hosts, IBAN countries, area numbers in use, first names.
GAZETTEER = {
    "secret": tuple("AKIA ASIA AIza ghp_ gho_ github_pat_ glpat- xoxb- xoxp- sk- sk_live_ pk_live_ rk_live_ SG. eyJ ya29. npm_ dop_v1_".split()),
    "email_text": frozenset("aol example free gmail gmx googlemail hotmail icloud laposte live mail msn orange outlook posteo proton protonmail terra web yahoo yandex zoho".split()),
    "account": frozenset("AD AE AL AT AZ BA BE BG BH BR CH CR CY CZ DE DK DO EE ES FI FO FR GB GE GI GL GR GT HR HU IE IL IS IT JO KW KZ LB LI LT LU LV MC MD ME MK MR MT MU NL NO PK PL PS PT QA RO RS SA SE SI SK SM TN TR UA VG XK".split()),
    "identity": frozenset(f"{n:03d}" for n in range(1, 773) if n != 666),
    "name": frozenset("""adam albert alex alice amelie anna anne anton antonio barbara bernd carlos carmen catherine charles charlotte christian claire claude
        daniel david dieter dolores elena elisabeth elizabeth emily emma erik eva felix fernando francisco francois frank franz frederic george hannah hans heinz
        helga henri ines isabel jack jacques james jan jane javier jean john jorge jose joseph juan julia karl katharina klaus laura lena louis louise lucas lucia
        luis maria marie mark marta martin mary michael michel miguel monika nicolas olivia oliver pablo patrick paul pedro peter philippe pierre rafael ramon
        richard robert rosa sarah sofia sophie stefan susan teresa thomas ursula victor werner william wolfgang yves""".split()),
}
CONTEXT = {
    "secret": re.compile(r"(?i)(?:credential|auth|login|config|export|private|deploy|env\b|account|access)"),
    "email_text": re.compile(r"(?i)(?:mail|contact|write|reach|courriel|correo)"),
    "account": re.compile(r"(?i)(?:iban|account|bank|konto|compte|cuenta)"),
    "identity": re.compile(r"(?i)(?:ssn|social|security|identity|id number)"),
    "name": re.compile(r"(?i)(?:dear|name|contact|sincerely|regards|signed|call)"),
}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind, in order of start, then of kind."""
    found: list[tuple[int, int, int]] = []
    if "@" in text:
        floor = 0
        for m in DOMAIN.finditer(text):
            start = m.start()
            while start > floor and text[start - 1] in LOCAL:
                start -= 1
            if start < m.start():
                found.append((start, 0, m.end()))
                floor = m.end()
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


def in_gazetteer(kind: str, value: str) -> bool:
    if kind == "secret":
        return value.startswith(GAZETTEER[kind])
    if kind in ("account", "identity"):
        return value[: 2 if kind == "account" else 3] in GAZETTEER[kind]
    return any(w in GAZETTEER[kind] for w in re.findall(r"[\w-]+", value.lower()))


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int, str, str]]:
    """(kind, start, end, votes, features): votes are + or - of the regex, + or 0 of gazetteer and context."""
    out: list[tuple[str, int, int, str, str]] = []
    low = text.lower()
    for kind, pattern in WIDE.items():
        hint = HINT[kind]
        if not (any(h in low for h in hint) if isinstance(hint, tuple) else hint.search(text)):
            continue
        for m in pattern.finditer(text):
            start, end = m.span(1)
            if any(s < end and start < e for _, s, e in taken):
                continue
            value, left = m[1], text[max(0, m.start() - LEFT) : m.start()]
            votes = "-+"[STRICT[kind].fullmatch(value) is not None] + "0+"[in_gazetteer(kind, value)] + "0+"[CONTEXT[kind].search(left) is not None]
            digits = sum(c.isdigit() for c in value)
            features = f"{kind}|{min(len(value).bit_length(), 8)}|{4 * digits // len(value)}|{int(any(c.isupper() for c in value))}|{int(len(set(value)) > 10)}|{int(text[start - 1 : start].isspace())}"
            out.append((kind, start, end, votes, features))
    return out


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, base, found) per row of ``docs``: arrays of spans and of candidates with votes and features."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            base = [base_spans(t or "") for t in batch["text"]]
            found = [candidates(t or "", b) for t, b in zip(batch["text"], base)]
            dicts = lambda rows, names: [[dict(zip(names, r)) for r in row] for row in rows]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "base": dicts(base, ("kind", "start", "end")), "found": dicts(found, ("kind", "start", "end", "votes", "features"))})

    # doc_id goes through as text: pandas has no integer column that holds nulls without rounding the others.
    schema = "doc_id string, base array<struct<kind:string,start:long,end:long>>, found array<struct<kind:string,start:long,end:long,votes:string,features:string>>"
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text").mapInPandas(read, schema).withColumn("doc_id", F.col("doc_id").cast("long"))


#: Where expectation-maximisation starts, and what it is held to by ``HELD`` imagined votes of each class: the
#: chance that a vote is for, given personal data, and given none. Labelers stay better than ``CHANCE``.
START = (0.9, 0.1)
HELD = 20.0
CHANCE = 0.6


def reliabilities(votes: dict[str, int], rounds: int = 50, balance: float = 0.5) -> tuple[dict[str, float], np.ndarray]:
    """Posteriors of vote patterns by expectation-maximisation over their counts (two classes of a given balance,
    labelers independent within a class, 0 being no vote), and the chance of each class and labeler that its vote is for."""
    patterns = sorted(votes)
    pro, con = (np.array([[c == sign for c in p] for p in patterns], dtype=float) for sign in "+-")
    n = np.array([votes[p] for p in patterns], dtype=float)
    rate = np.repeat(np.array(START)[:, None], pro.shape[1], axis=1)
    for _ in range(rounds):
        log = [np.log(s) + pro @ np.log(r) + con @ np.log(1 - r) for s, r in zip((balance, 1 - balance), rate)]
        yes = 1 / (1 + np.exp(np.clip(log[1] - log[0], -50, 50)))
        for k, (w, low, high) in enumerate(((n * yes, CHANCE, 0.999), (n * (1 - yes), 0.001, 1 - CHANCE))):
            rate[k] = np.clip((w @ pro + HELD * START[k]) / (w @ (pro + con) + HELD), low, high)
    return dict(zip(patterns, yes.tolist())), rate


def span_classifier(counts: list[tuple[str, str, int]], posterior: dict[tuple[str, str], float], rounds: int = 300) -> dict[tuple[str, str], float]:
    """Logistic regression on one-hot features and votes, trained on the posteriors as soft labels and
    weighted by counts. Returns the probability of each combination that occurs."""
    if not counts:
        return {}
    described = [[f"{i}={v}" for i, v in enumerate(f.split("|"))] + [f"vote{i}{v}" for i, v in enumerate(votes)] for f, votes, _ in counts]
    names = {name: k for k, name in enumerate(sorted({n for d in described for n in d}))}
    x = np.zeros((len(counts), len(names) + 1))
    x[:, -1] = 1
    for row, d in enumerate(described):
        x[row, [names[n] for n in d]] = 1
    y = np.array([posterior[kind_of(f), votes] for f, votes, _ in counts])
    weight = np.array([c for _, _, c in counts], dtype=float)
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        w -= 2.0 * (x.T @ (weight * (p - y)) + 1e-4 * w)
    p = 1 / (1 + np.exp(-x @ w))
    return {(f, votes): float(v) for (f, votes, _), v in zip(counts, p)}


def chosen_candidates(seen: DataFrame, threshold: float = THRESHOLD) -> list[str]:
    """Which combinations of features and votes count as personal data, learned from ``seen`` as a whole."""
    counted = seen.select(F.explode("found").alias("c")).groupBy("c.features", "c.votes").agg(F.count("*").alias("n")).orderBy("features", "votes")
    counts = [(r["features"], r["votes"], r["n"]) for r in counted.collect()]
    posterior = {(kind, v): p for kind in WIDE for v, p in posteriors_of(kind, counts).items()}
    return sorted(f"{f}|{v}" for (f, v), p in span_classifier(counts, posterior).items() if p >= threshold)


def posteriors_of(kind: str, counts: list[tuple[str, str, int]]) -> dict[str, float]:
    votes: dict[str, int] = {}
    for f, v, n in counts:
        if kind_of(f) == kind:
            votes[v] = votes.get(v, 0) + n
    return reliabilities(votes)[0] if votes else {}


def kind_of(features: str) -> str:
    return features.split("|", 1)[0]


def find_personal_data(spark: SparkSession, docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, base, added): arrays of (kind, start, end) per row of ``docs``."""
    seen = Scratch(spark, "pii").keep(detected(docs), "detected")
    allowed = F.array(*map(F.lit, chosen_candidates(seen, threshold))).cast("array<string>")
    added = F.transform(F.filter("found", lambda c: F.array_contains(allowed, F.concat_ws("|", c["features"], c["votes"]))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return seen.select("doc_id", "base", added.alias("added"))


def listed(spans, order: tuple[str, ...] = (*KINDS, *WIDE)):
    """kind:start:end by start, then by kind as listed, joined by commas."""
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, order)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in angle brackets; spans that
    overlap are replaced together, up to the furthest end, by the kind of the first, then the longest."""
    allowed = frozenset(chosen_candidates(detected(docs), threshold))

    @F.pandas_udf("string")
    def masked(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if t:
                base = base_spans(t)
                added = [(k, s, e) for k, s, e, votes, features in candidates(t, base) if f"{features}|{votes}" in allowed]
                parts, at = [], 0
                for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
                    if start >= at:
                        parts += [t[at:start], f"<{kind.upper()}>"]
                    at = max(at, end)
                t = "".join(parts) + t[at:]
            out.append(t)
        return pd.Series(out, dtype=object)

    return docs.withColumn("text", masked(F.col("text")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(spark, table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"))
