"""Brute-force versions, exact round trips and edge cases of the ten operators, on small tables."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from biblark.llm import decontaminate, html_text, packing, pii, quality, queries, simhash, token_counts, tokens, toxicity, vectors, warc
from biblark.llm.common import connected_components, Scratch
from tests.oracle import assert_same, connection

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, _text_hash string, _leak string, row string, fp string"


def documents(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "web", len(t or ""), "x", "x", "x", "x", "x") for i, t in enumerate(texts)], DOCS)


ODD = [None, "", " \t\n", "a", "same words here again", "same words here again", "🦜" * 50, "word " * 30_000, "x" * 100_000]


# ---- packing


def test_tokens_of_both_libraries_agree():
    import public_tokenizers
    from tokenizers import Tokenizer

    encode, slow = tokens.encoder(*tokens.default_paths()), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for t in ["", "Hello, world!  It's 3 o'clock\n\n\tnow", "Straße naïve 東京 🦜", "a <|endoftext|> b", "  x  "]:
        assert encode(t) == slow.encode(t, add_special_tokens=False).ids


def test_packing(spark):
    texts = [*ODD, *["tok " * (37 * i % 900) for i in range(200)]]
    rows = packing.pack_documents(spark, documents(spark, texts)).collect()
    encode = tokens.encoder(*tokens.default_paths())
    at, sums, pieces = {}, {}, {}
    for r in rows:
        at.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        pieces.setdefault(r["doc_id"], []).append(r)
    for spans in at.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= 1024
    for i, t in enumerate(texts):
        ids = np.array([*encode(t or ""), 2], dtype="<u4")
        own = sorted(pieces[i], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert len(own) == -(-len(ids) // 1024) and all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
    assert len(at) <= 1.02 * sum(r["length"] for r in rows) / 1024 + 2


def test_packing_empty(spark):
    assert packing.pack_documents(spark, documents(spark, []).limit(0)).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    h = np.bincount(rng.integers(1, 1025, 5000), minlength=1025)
    used = np.zeros(1025, dtype=int)
    for lengths, times in packing.plan_packing(h):
        assert sum(lengths) <= 1024 and times > 0
        for n in lengths:
            used[n] += times
    assert (used == h).all()


# ---- token counts


BATCH = "op string, doc_id long, source string, lang string, tokenizer string, tokens long, seq long"


def test_rollup(spark, tmp_path):
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    batch = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], BATCH)
    assert roll.totals().count() == 0
    first = batch(("insert", 1, "web", "en", "v", 10), ("insert", 2, "web", None, "v", 5), ("insert", 3, None, "en", "v", 7), ("revise", 4, "new", "en", "v", 3), ("insert", 5, "gone", "en", "v", 3), ("delete", 5, "gone", "en", "v", 3), ("insert", None, "loose", "en", "v", 2), ("insert", None, "loose", "en", "v", 2))
    assert roll.commit("a/b=c d", first) and not roll.commit("a/b=c d", first)
    assert ("new", "en", "v", 1, 3) in {tuple(r) for r in roll.totals().collect()}  # a revision in the first batch is an insert
    second = batch(("delete", 1, "web", "en", "v", 0), ("revise", 3, "moved", "en", "v", 9), ("delete", 99, "web", "en", "v", 0), ("insert", 2, "web", None, "v", 5), ("delete", None, "loose", "en", "v", 2))
    assert roll.commit("b", second)
    assert roll.commit("c", batch().limit(0)) and not roll.commit("b", second)
    got = {tuple(r) for r in roll.totals().collect()}
    assert got == {("web", None, "v", 1, 5), ("moved", "en", "v", 1, 9), ("new", "en", "v", 1, 3), ("loose", "en", "v", 2, 4)}


def test_rollup_equals_a_recount(spark, tmp_path):
    """Random batches, some of them broken off before their commit and some repeated."""
    rng = np.random.default_rng(12)
    roll = token_counts.TokenRollup(spark, f"file://{tmp_path}/rollup")
    held, n = {}, 0
    for serial in range(6):
        rows = []
        for _ in range(60):
            n += 1
            op = ("insert", "revise", "delete")[rng.integers(3)]
            rows.append((op, int(rng.integers(40)), f"s{rng.integers(3)}", None if rng.integers(4) == 0 else "en", f"v{rng.integers(2)}", int(rng.integers(100)), n))
            key = rows[-1][1], rows[-1][4]
            if op == "delete":
                held.pop(key, None)
            else:
                held[key] = rows[-1]
        frame = spark.createDataFrame([rows[i] for i in rng.permutation(len(rows))], BATCH)
        if serial in (2, 4):  # an earlier try left rows behind without a commit
            frame.limit(5).selectExpr("doc_id", "source", "lang", "tokenizer", "1L docs", "tokens").write.parquet(f"file://{tmp_path}/rollup/ledger/serial={serial + 1}")
        assert roll.commit(f"batch {serial}", frame)
        assert not roll.commit(f"batch {serial}", frame)
        want = {}
        for op, _, source, lang, version, size, _ in held.values():
            d, t = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (d + 1, t + size)
        assert {tuple(r)[:3]: tuple(r)[3:] for r in roll.totals().collect()} == want


def test_token_counts_have_all_documents(spark):
    con = connection("/root/testdata/sf0.01")
    want = con.sql("SELECT source, lang, count(*) FROM documents GROUP BY ALL").fetchall()
    assert {tuple(r) for r in queries.QUERIES["op2_token_counts"](spark, "/root/testdata/sf0.01").select("source", "lang", "docs").collect()} == set(want)


def test_token_counts_by_hand(spark):
    encode = tokens.encoder(*tokens.default_paths())
    want = {}
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        n, k = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, k + len(encode(r["text"] or "")))
    got = {(r["source"], r["lang"]): (r["docs"], r["tokens"]) for r in queries.QUERIES["op2_token_counts"](spark, SMALL).collect()}
    assert got == want


# ---- personal data

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in pattern.finditer(text):
            digits = re.sub(r"[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, kind, m.end()))
    return [(kind, s, e) for s, _, kind, e in sorted(out)]


def test_base_spans_by_plain_patterns(spark):
    rng = np.random.default_rng(4)
    alphabet = list("a.Z9@@+-%_ 0123456789..  ()é\n")
    texts = ["".join(rng.choice(alphabet, rng.integers(0, 60))) for _ in range(4000)]
    texts += ["4111 1111 1111 1111", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "+1 (202) 555-0123.", "300.1.1.1 10.0.0.1", "000000000255.1.1.1"]
    texts += [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    for t in texts:
        assert pii.base_spans(t) == plain_spans(t)


def test_pii_rows(spark):
    texts = [*ODD, "mail joe@example.org or api_key = AbCdEf0123456789XyZ9 and 10.0.0.1", "mail joe@example.org"]
    rows = {r["doc_id"]: r for r in pii.find_personal_data(spark, documents(spark, texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert [(s["kind"], s["start"], s["end"]) for s in rows[i]["base"]] == plain_spans(t or "")
    masked = {r["doc_id"]: r["text"] for r in pii.redact(documents(spark, texts)).collect()}
    assert masked[len(texts) - 1] == "mail <EMAIL>" and masked[0] is None and masked[1] == ""
    assert "10.0.0.1" not in masked[len(texts) - 2]


def test_pii_query_digest(spark):
    text = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.QUERIES["op3_pii"](spark, SMALL).collect():
        spans = plain_spans(text[r["doc_id"]])
        said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
        assert r["base_sha256"] == hashlib.sha256(said.encode()).hexdigest()
        assert r["n_email"] == sum(k == "email" for k, _, _ in spans)
        assert set(filter(None, said.split(","))) <= set(r["spans"].split(","))


def test_reliabilities_tell_good_labelers():
    posterior, rate = pii.reliabilities({"+++": 500, "-00": 300, "++0": 100, "-0+": 80, "+0+": 30})
    assert posterior["+++"] > 0.9 > 0.5 > posterior["-00"]
    assert (rate[0] > rate[1]).all()


def test_reliabilities_by_simulation():
    """Votes of two classes with known chances: the estimates come near them."""
    rng = np.random.default_rng(9)
    true = np.array([[0.9, 0.8, 0.7], [0.1, 0.3, 0.2]])
    votes = {}
    for y in rng.random(20_000) < 0.4:
        p = "".join("0" if rng.random() < 0.2 else "+" if rng.random() < c else "-" for c in true[0 if y else 1])
        votes[p] = votes.get(p, 0) + 1
    _, rate = pii.reliabilities(votes, rounds=300, balance=0.4)
    assert np.abs(rate - true).max() < 0.05


def test_added_spans(spark):
    """Planted data of each kind is added with its exact place, look-alikes are not; the learned choice equals the
    one made of the collected candidates."""
    rng = np.random.default_rng(10)
    key = lambda: "".join(rng.choice(list("abcdefghijkABCDEFGH0123456789"), 40))
    plain = ["the secret: everything", "password = something", "see figure 123-45-67890 of it", "Dr. No", "we meet at noon"]
    texts, want = [], {}
    for i in range(60):
        value, kind, text = [
            (v := key(), "secret", f"please set api_key = {v} today"),
            (v := f"DE{rng.integers(10, 99)} {rng.integers(1000, 9999)} {rng.integers(1000, 9999)} {rng.integers(1000, 9999)} {rng.integers(1000, 9999)}", "account", f"our bank account {v} is new"),
            (v := f"{rng.integers(100, 600)}-{rng.integers(10, 99)}-{rng.integers(1000, 9999)}", "identity", f"his social security number {v} ends"),
            (v := f"{rng.choice(['Anna', 'Peter', 'Maria'])} {rng.choice(['Schmidt', 'Lopez', 'Durand'])}", "name", f"dear Frau {v} of the house"),
        ][i % 4]
        want[len(texts)] = f"{kind}:{text.index(value)}:{text.index(value) + len(value)}"
        texts += [text, plain[i % 5] + f" {i}"]
    docs = documents(spark, texts)
    got = {r["doc_id"]: ",".join(f"{s['kind']}:{s['start']}:{s['end']}" for s in r["added"]) for r in pii.find_personal_data(spark, docs).collect()}
    assert {i: s for i, s in got.items() if s} == want
    counts = {}
    for t in texts:
        for _, _, _, votes, features in pii.candidates(t, pii.base_spans(t)):
            counts[features, votes] = counts.get((features, votes), 0) + 1
    listed = [(f, v, n) for (f, v), n in counts.items()]
    posterior = {(k, v): p for k in pii.WIDE for v, p in pii.posteriors_of(k, listed).items()}
    assert pii.chosen_candidates(pii.detected(docs)) == sorted(f"{f}|{v}" for (f, v), p in pii.span_classifier(listed, posterior).items() if p >= pii.THRESHOLD)


# ---- classifiers


@pytest.mark.parametrize("name,label,fold", [("op4_quality_classifier", "quality", 5), ("op7_toxicity", "toxic", 4)])
def test_held_out(spark, name, label, fold):
    folder = "/root/testdata/sf0.01"
    rows = queries.QUERIES[name](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % fold == (0 if fold == 5 else 2)) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) >= 0.9


def test_classifiers_take_odd_texts(spark):
    docs = documents(spark, ODD)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(9)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for module in (quality, toxicity):
        for known in (labels, none):
            rows = module.score(docs.select("doc_id", "text"), module.train(docs, known.unionByName(spark.createDataFrame([(0, 7, -3), (1, None, 2)], known.schema)))).collect()
            assert len(rows) == len(ODD) and all(0 <= r["score"] <= 1 for r in rows)
    assert quality.good(docs, None).columns == docs.columns


def test_network_gradient():
    rng = np.random.default_rng(0)
    net = quality.Network()
    texts = [bytes(rng.integers(97, 123, n).astype(np.uint8)) + b" aa aa" for n in (40, 300, 5)]
    y = np.array([1, 0, 1], np.float32)
    loss = lambda: -np.mean(np.where(y == 1, np.log(net.scores(texts)), np.log(1 - net.scores(texts))))
    g = net.gradient(texts, y)
    for key, index in (("out", 0), ("out", quality.FILTERS + 3), ("shift", 0), ("bias", 2)):
        at = net.p[key].copy()
        values = []
        for step in (1e-2, -1e-2):
            net.p[key] = at.copy()
            net.p[key].flat[index] += step
            values.append(loss())
        net.p[key] = at
        assert abs((values[0] - values[1]) / 2e-2 - g[key].flat[index]) < 2e-3


def test_grammar_reads_clauses():
    g = toxicity.Grammar({"idiot": 3.0}, {})
    total = lambda text: sum(g.clause_score(c) for c in g.clauses(text))
    near = lambda text, value: abs(total(text) - value) < 1e-9
    assert near("idiot", 3.0) and near("The word idiot is old.", 3.0) and near("you are an idiot", 4.5)
    assert near("no idiot", 0.9) and near("you are not an idiot", 2.4) and near("not once in my life an idiot", 3.0)
    assert near("i will kill you", 3.0) and near("kill", 0.0) and near("do not kill", 0.0) and near("i will not kill you", 0.9)
    assert near("Anna said: idiot", 1.2) and near("he said: idiot", 2.7) and near("he wrote that you are no idiot", 0.6) and near("note: idiot", 3.0)
    assert near('the "idiot" again', 1.2) and near("« idiot » idiot", 4.2) and near('"go. idiot." idiot', 4.2)
    assert near('an open " mark\nidiot', 3.0)  # a line ends quotation
    assert near("he said so. idiot", 3.0)  # a sentence ends reported speech
    assert g.features("idiot") == g.features("idiot.") == g.features(" idiot ...!\n")
    assert g.features(None) == g.features("") == g.features('."') == [0.0] * toxicity.FEATURES


@pytest.mark.parametrize("learned", [False, True])
def test_marks_keep_their_signs(learned):
    """Also where the labels would teach the opposite: toxic texts deny, clean ones aim."""
    texts = [t for k in range(40) for t in (f"this is not an idiot at all number{k} w{k}. and no scum here", f"you see an idiot w{k} once. then much else. and more of it. and more")]
    grammar = toxicity.learn(texts, np.array([1, 0] * 40)) if learned else toxicity.learn([], np.array([]))
    assert grammar.weights is None or (grammar.weights[:-2] >= 0).all()
    of = lambda text: grammar.score(np.array([grammar.features(text)]))[0]
    order = ["the word is not idiot", "the word is idiot", "the word is you idiot"]
    said = ["he wrote: you idiot", "you idiot"]
    threat = ["i will not kill you", "i will kill you"]
    for row in (order, said, ['the "idiot"', "the idiot"], threat):
        scores = [of(t) for t in row]
        assert scores == sorted(scores) and (learned or len(set(scores)) == len(scores))


# ---- SimHash


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_by_brute_force(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(40)]
    near = [" ".join([*t.split()[:-1], "end"]) for t in base]
    texts = [*ODD[:7], *base, *near, *base[:5], "É Été ABC déf g", "a b c", "A B C"]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark, documents(spark, texts)).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(texts)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4 and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    for i in range(len(texts)):
        assert got[i]["fp"] & (1 << 64) - 1 == prints[i] and got[i]["component_id"] == find(i)
    kept = simhash.one_of_each(spark, documents(spark, texts)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({find(i) for i in range(len(texts))})
    assert all(r["_text_hash"] == "x" for r in kept)


@pytest.mark.parametrize("tile", [16, 64])
def test_simhash_tiles_lose_no_link(spark, tile):
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 1 << 63, 3, dtype=np.uint64)
    flips = [(c ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 3, replace=False).astype(np.uint64))) for c in centre for _ in range(150)]
    fps = np.unique(np.array(flips, dtype=np.uint64)).view(np.int64).tolist()
    scratch = Scratch(spark, "test")
    links = simhash.near_links(spark, spark.createDataFrame([(f,) for f in fps], "fp long"), scratch, tile=tile)
    roots = {r["node"]: r["root"] for r in connected_components(links, scratch).collect()}
    u = np.array(fps).view(np.uint64)
    near = np.bitwise_count(u[:, None] ^ u[None, :]) <= 4
    for i, j in zip(*np.nonzero(np.triu(near, 1))):
        assert roots[fps[i]] == roots[fps[j]]
    for r in links.collect():
        assert ((r["a"] ^ r["b"]) & (1 << 64) - 1).bit_count() <= 64


def test_simhash_empty(spark):
    assert simhash.near_duplicates(spark, documents(spark, []).limit(0)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5000, 5001), (5001, 5000)]
    got = connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "test")).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 50, 201]


# ---- vectors


def test_vectors_by_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(60, 32))
    x = [(c + rng.normal(scale=0.25, size=32)).tolist() for c in centres for _ in range(6)]
    x += [x[0], x[0], [0.0] * 32, None, [1.0, None, *[0.0] * 30], [float("nan")] * 32, [float("inf")] * 32, [1.0] * 5]
    rows = [(i, v) for i, v in enumerate(x)]
    got = {r["vec_id"]: r for r in vectors.near_vectors(spark, spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    good = [i for i, v in rows if v and len(v) == 32 and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    u = np.array([np.asarray(x[i], dtype=np.float32) for i in good], dtype=np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.9
    np.fill_diagonal(link, False)
    found = sum(got[i]["n_links"] for i in good)
    assert link.sum() * 0.9 <= found <= link.sum()
    for i in set(range(len(x))) - set(good):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    for i, want in zip(good, link.sum(1)):
        assert got[i]["n_links"] <= want
    assert got[360]["component_id"] == got[361]["component_id"] == got[0]["component_id"]


def test_vectors_empty(spark):
    assert vectors.near_vectors(spark, spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


# ---- decontamination


def test_decontamination(spark):
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    item = [word() for _ in range(40)]
    other = [word() for _ in range(400)]
    turned = [*other[:50], *item[20:], *other[50:90], *item[:20], *other[90:]]
    texts = [*ODD, " ".join(turned), " ".join(item).upper(), " ".join(other), " ".join(other[:60] + item[:12] + other[60:])]
    items = spark.createDataFrame([(7, " ".join(item)), (8, " ".join(item)), (9, None), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark, documents(spark, texts), items).collect()}
    n = len(ODD)
    assert got == {(n, 7), (n, 8), (n + 1, 7), (n + 1, 8)}
    assert decontaminate.contaminated(spark, documents(spark, []).limit(0), items).count() == 0
    assert decontaminate.contaminated(spark, documents(spark, texts), items.limit(0)).count() == 0


def test_decontamination_on_tables(spark):
    """Every document that holds a benchmark passage word for word is found."""
    words = lambda t: " " + " ".join(re.findall(r"[^\W_]+", (t or "").lower())) + " "
    docs = {r["doc_id"]: words(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    items = [words(r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    want = {i for i, t in docs.items() if any(p in t for p in items)}
    got = {r["doc_id"] for r in queries.QUERIES["op8_benchmark_decontamination"](spark, "/root/testdata/sf0.01").collect()}
    assert want and want <= got and len(got) <= len(want) * 1.5 + 3


# ---- archives


def test_archives_match_sql(spark):
    assert_same(queries.QUERIES["op9_warc"](spark, SMALL), connection(SMALL), queries.ORACLE_SQL["op9_warc"])


@pytest.mark.parametrize("version", [1, 2])
def test_archive_round_trip(spark, tmp_path, version):
    long = "<p>" + "é\r\n\r\nWARC/1.0\r\n" * 5000
    rows = [(5, "http://a/ x", long), (3, None, long), (4, "http://b/", None), (6, "http://c", ""), (7, "u", "short"), (8, "u", "short"), (None, "n", "n" * 200), (3, None, long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_arc(pages, f"file://{tmp_path}/arc", version)
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = warc.read_warc_files(spark, f"file://{tmp_path}/warc").collect()
    assert len(got) == len(rows) and not any(r["rejected"] for r in got)
    by = {(r["page_id"], r["record_type"]): r for r in got}
    assert by[5, "revisit"]["refers_to"] == 3 and by[5, "revisit"]["payload_digest"] == hashlib.sha256(long.encode()).hexdigest()
    assert by[4, "response"]["payload_bytes"] == 0 and by[7, "response"]["refers_to"] is None


def foreign_arc(version, records, extra=b""):
    """An archive as crawlers wrote them: version block, then header lines and blocks; ``records`` are (header, block)."""
    names = b"URL IP-address Archive-date Content-type Archive-length" if version == 1 else b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
    block = b"%d 0 Crawler Inc.\n%s\n" % (version, names)
    tail = b"%d" % len(block) if version == 1 else b"200 - - 0 x.arc %d" % len(block)
    out = b"filedesc://x.arc 0.0.0.0 19960923142103 text/plain " + tail + b"\n" + block
    for header, body in records:
        out += b"\n" + header + (b" %d" % len(body) if header else b"") + b"\n" + body
    return out + extra


def converted(spark, tmp_path, *archives):
    import gzip

    (tmp_path / "arc").mkdir()
    for i, a in enumerate(archives):
        (tmp_path / "arc" / f"{i}.arc.gz").write_bytes(gzip.compress(a))
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    return warc.read_warc_files(spark, f"file://{tmp_path}/warc")


@pytest.mark.parametrize("version", [1, 2])
def test_foreign_archives(spark, tmp_path, version):
    """Bare line feeds, no HTTP at all, dns records, spaces in headers, bytes that are no UTF-8: payloads are exact."""
    rest = b"" if version == 1 else b" 200 sum - 77 x.arc"
    body = bytes(range(256)) * 2
    records = [
        (b"http://a.example/ 192.0.2.1 19960923142103 text/html" + rest, b"HTTP/1.0 200 OK\nServer: x\n\n" + body),
        (b"http://b.example/ 192.0.2.1 19960923142103 text/html; charset=x" + rest, b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n" + b"\n\n" + body),
        (b"dns:c.example 192.0.2.9 20000101000000 text/dns" + rest, b"20000101\nc.example. 3600 IN A 192.0.2.3\n"),
        (b"http://d.example/a b 192.0.2.1 19960923 text/html" + rest, b"<html>no head at all</html>"),
        (b"http://e.example/ 192.0.2.1 19960923142103 no-type" + rest, b"HTTP/1.0 304 Not Modified\r\nServer: x"),
    ]
    got = {r["url"]: r for r in converted(spark, tmp_path, foreign_arc(version, records)).collect()}
    want = [body, b"\n\n" + body, records[2][1], records[3][1], b""]
    assert len(got) == 5
    for (header, _), payload in zip(records, want):
        row = got[re.split(rb" (?=192)", header)[0].decode()]
        assert row["payload_bytes"] == len(payload) and row["payload_digest"] == hashlib.sha256(payload).hexdigest() and row["rejected"] is None
    assert got["dns:c.example"]["record_type"] == "resource" and got["http://a.example/"]["record_type"] == "response"
    assert got["http://d.example/a b"]["date"] == "1996-09-23T00:00:00Z"


def test_bad_headers_are_kept_aside(spark, tmp_path):
    good = lambda i: (b"http://g%d.example/ 192.0.2.1 19960923142103 text/html" % i, b"HTTP/1.0 200 OK\r\n\r\nbody %d" % i)
    mixed = foreign_arc(1, [good(1), (b"", b"some bytes\nthat are no record\n"), good(2), (b"http://h.example/ 192.0.2.1 19961399999999 text/html", b"HTTP/1.0 200 OK\r\n\r\nx"), good(3)], extra=b"\nhttp://cut.example/ 192.0.2.1 19960923142103 text/html 500\nHTTP/1.0")
    rows = converted(spark, tmp_path, mixed, foreign_arc(1, [good(4)]))
    assert {r["rejected"]: r["n"] for r in warc.rejected(rows).collect()} == {"header line": 1, "date": 1, "cut short": 1}
    assert rows.where("rejected is null").count() == 4


def test_revisits_name_their_response(spark, tmp_path):
    same = "s" * 300
    rows = [(i, f"http://{i}/", same) for i in (9, 4, 7, 4)] + [(None, "n", same), (None, "n", "n" * 200), (None, "m", "n" * 200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_arc(pages, f"file://{tmp_path}/arc")
    warc.convert(spark, f"file://{tmp_path}/arc", f"file://{tmp_path}/warc")
    got = warc.read_warc_files(spark, f"file://{tmp_path}/warc").collect()
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(rows)
    kinds = sorted((r["page_id"] or 0, r["url"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 300)
    assert kinds == [(0, "n", "revisit", 4), (4, "http://4/", "response", None), (4, "http://4/", "response", None), (7, "http://7/", "revisit", 4), (9, "http://9/", "revisit", 4)]
    assert all(ids[r["refers_to_id"]]["record_type"] == "response" for r in got if r["refers_to_id"])
    assert [r["record_type"] for r in got if r["payload_bytes"] == 200] == ["response"] * 2


def test_archives_of_an_empty_table_and_clashing_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    more = spark.createDataFrame([(1, "u", "h", "x", "y")], "page_id long, url string, html string, archive string, payload string")
    for name, pages, n in (("e", empty, 0), ("m", more, 1)):
        warc.write_arc(pages, f"file://{tmp_path}/{name}")
        warc.convert(spark, f"file://{tmp_path}/{name}", f"file://{tmp_path}/{name}w")
        assert warc.read_warc_files(spark, f"file://{tmp_path}/{name}w").count() == n


def test_damage_ends_the_reading():
    record = warc.warc_record(dict(zip([f.split(" ")[0] for f in warc.RECORD.split(", ")], warc.arc_to_record(next(warc.read_arc(warc.arc_opening(1, "n") + warc.arc_record(1, 1, "http://a/", "body", 0, "n")))))) | {"refers_to_id": None})
    (head, block), = warc.read_warc(record)
    assert warc.warc_to_row(head, block)[5] == 4
    with pytest.raises(ValueError):
        warc.warc_to_row(head, block.replace(b"body", b"bodY"))


# ---- pages


def test_pages(spark):
    page = lambda title, body: f"<html><head><title>t</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div id=main><h1>{title}</h1><p>{body}</p></div><div class='sidebar'>More</div><footer>c</footer><script>x<1</script></body></html>"
    rows = [(i, "http://h.example/x", page(f"Title {i}", f"Body&nbsp;text &amp; number {i}<br>second   line")) for i in range(6)]
    rows += [(10, None, None), (11, "http://h.example/", ""), (12, "x", "<div>" * 3000 + "deep"), (13, "y", "plain < text"), (13, "y", "plain < text"), (14, "z", "<!-- open")]
    got = [(r["page_id"], r["text"]) for r in html_text.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    by = dict(got)
    assert len(got) == len(rows)
    assert by[3] == "Title 3 Body text & number 3 second line"
    assert by[10] == by[11] == by[14] == "" and by[12] == "deep" and by[13] == "plain < text"
    assert html_text.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# ---- the whole pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet").withColumn("score", F.lit("kept")).withColumn("_leak", F.lit("kept"))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SMALL)
        assert after.columns == docs.columns, name
        assert 0 < after.count() <= before
        docs = after
    assert docs.where("score <> 'kept' or _leak <> 'kept'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).select("doc_id").distinct().count() == docs.count()
