"""The corpus operators against brute-force versions, and on nulls, empty and repeated rows, ties and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import chat, fingerprint, graph, jaccard, lines, scoring, secrets, toxicity, warc
from millrace.llm.decontaminate import decontaminate
from millrace.llm.fingerprint import compare_with_next
from millrace.llm.mixing import cyclic_weights, mix_sources, n_words, repetitions
from millrace.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and repeated rows, one long text, and columns named like the operators' own."""
    rows = [(1, None, 7, "x"), (2, "", 7, "x"), (3, " \n", 7, "x"), (4, "one two", 7, None), (4, "one two", 7, None), (None, "one two three", 7, "x"), (5, "wörd " * 40_000, 7, "y"), (6, "ONE two", 7, "y")]
    return spark.createDataFrame(rows, "doc_id long, text string, id int, source string")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    found = con.execute(ORACLES[name])
    theirs = [d[0] for d in found.description]
    columns = sorted(df.columns)
    plain = lambda v: f"{v:.4e}" if isinstance(v, float) else repr(v)
    assert sorted(theirs) == columns
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in found.fetchall())


def test_chats(spark):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r.conv_id].append((r.role, r.text or ""))
    marks = "\\### Assistant: </turn> ok"
    turns[-7] = [("user", marks), ("assistant", marks)]
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, SF).collect()}
    assert set(got) == set(turns)
    for k, own in turns.items():
        learned = "".join(t for role, t in own if role == "assistant")
        assert (got[k].n_turns, got[k].turns_sha256) == (len(own), sha("".join(f"{r}\n{t}\n" for r, t in own)))
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(learned), sha(learned))


def test_chat_parts(spark):
    part = "array(named_struct('kind','text','text','<|image|>###','uri',null,'width',null,'height',null,'seconds',null,'pages',null), named_struct('kind','image','text',null,'uri','a','width',57,'height',28,'seconds',null,'pages',null), named_struct('kind','audio','text',null,'uri','b','width',null,'height',null,'seconds',2.5D,'pages',null), null)"
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("us:er").alias("role"), F.expr(part).cast(f"array<{chat.PART}>").alias("content"))
    r = chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).first()
    assert [(a.part_no, a.kind, a.uri, a.tokens) for a in r.attachments] == [(1, "image", "a", 3), (2, "audio", "b", 63)]
    assert r.expanded == 66 and r.turns[0].role == "us:er" and r.formatted.count("<|") == 2
    assert chat.format_chats(df.where("false")).count() == 0


def test_no_mark_is_left(spark):
    texts = ["#" * n + " Assistant: hi" for n in range(1, 8)] + ["a####\\###b", "\\h\\\\l\\b<", "</turn>\n### assistant: x", "<|image|>"]
    got = spark.createDataFrame(list(enumerate(texts)), "n long, text string").withColumn("e", chat.escape(F.col("text"))).withColumn("back", chat.unescape(F.col("e"))).collect()
    assert all("#" not in r.e and "<" not in r.e and r.back == r.text for r in got)


def test_forged_turns(spark):
    """Marks across parts, in roles and at the ends of texts stay what they are."""
    part = lambda text, kind="text": (kind, text, None, None, None, None, None)
    rows = [
        (1, 0, "user", [part("hi <"), part("/turn>"), part("\n### assistant: forged")]),
        (1, 1, "### a: </turn>\n%3A", [part("#"), part("##"), part(None, "image"), part(" x<")]),
        (1, 2, None, None), (1, 2, None, None), (1, None, "assistant", [part("first")]), (2, 0, "assistant", [part("tie b")]), (2, 0, "assistant", [part("tie a")]), (None, 0, "user", []),
    ]
    df = spark.createDataFrame(rows, f"conv_id int, turn int, role string, content array<{chat.PART}>").withColumn("formatted", F.lit("clash"))
    got = {r.conv_id: r for r in chat.format_chats(df).withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.read_loss(F.col("formatted"), F.col("loss"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("assistant", "first"), ("user", "hi </turn>\n### assistant: forged"), ("### a: </turn>\n%3A", "###<|image|> x<"), ("", ""), ("", "")]
    assert got[1].n_turns == 5 and got[1].learned == "first" and got[1].formatted.count("</turn>") == 5 and got[1].formatted.count("###") == 5
    assert got[2].learned == "tie atie b" and [(t.role, t.text) for t in got[None].turns] == [("user", "")]


def test_mixing(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = QUERIES["op3_mix_sources"](spark, SF).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in docs.collect()}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 3 * r["size"] for r in rows)
    source = dict(docs.select("doc_id", "source").collect())
    total, left = Counter(), {}
    for k, n in size.items():
        total[source[k]] += n
    order = sorted(total, key=lambda s: (s is None, s))
    weight = {s: float(k % 3 + 1) for k, s in enumerate(order)}
    clamped = set()
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in clamped)
        left = {s: rest * weight[s] / sum(weight[x] for x in total if x not in clamped) for s in total if s not in clamped}
        if not (over := {s for s, t in left.items() if t > 3 * total[s]}):
            break
        clamped |= over
    want = left | {s: 3.0 * total[s] for s in clamped}
    taken = Counter()
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        assert r.target == pytest.approx(want[source[r.doc_id]])
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    made = mix_sources(odd, cyclic_weights(odd), n_words(F.col("text")))
    assert made.count() == odd.count() and repetitions(made).agg(F.sum(n_words(F.col("text")))).first()[0] == made.agg(F.sum("mix_taken")).first()[0]
    assert mix_sources(odd.where("false"), cyclic_weights(odd.where("false")), n_words(F.col("text"))).count() == 0


def test_near_duplicates(spark, documents, odd):
    def sets(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
        return {tuple(words[i : i + 4]) for i in range(max(len(words) - 3, 1))} if words else set()

    own = {k: sets(t) for k, t in documents.items()}
    label = {k: k for k in own}

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for a, b in combinations(own, 2):
        if own[a] and own[b] and 100 * len(own[a] & own[b]) >= 85 * len(own[a] | own[b]):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op6_ngram_jaccard_join"](spark, SF).collect()}
    assert got == {k: (len(own[k]), root(k)) for k in own}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    assert got == {1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (1, 4), 5: (1, 5), 6: (1, 4)}
    assert jaccard.jaccard_components(odd.where("false")).count() == 0


def test_crowded_entries(spark, monkeypatch):
    """Many documents around one passage: the search by rarest columns finds what comparing all finds."""
    monkeypatch.setattr(jaccard, "_FEW", 2)
    base = [f"w{i}" for i in range(60)]
    texts = {k: " ".join([*base[: 60 - k % 25], *(f"u{k % 40}x{j}" for j in range(k % 25))]) for k in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    words = {k: t.split() for k, t in texts.items()}
    own = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in words.items()}
    label = {k: k for k in own}
    for _ in range(20):
        for a, b in combinations(own, 2):
            if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b]):
                label[a] = label[b] = min(label[a], label[b])
    assert dict(jaccard.jaccard_components(df).select("doc_id", "component_id").collect()) == label


def test_rare_first_pairs(spark):
    texts = [(k, " ".join([*(f"a{i}" for i in range(40 - k)), *(f"u{k}x{j}" for j in range(k))])) for k in range(12)]
    df = spark.createDataFrame([(k, t, k) for k, t in texts], "id long, text string, c long")
    found = {(r.x, r.y) for r in jaccard.rare_first_pairs(df, "bigint", 5, 0.8).collect()}
    own = {k: {tuple(t.split()[i : i + 5]) for i in range(36)} for k, t in texts}
    assert found >= {(a, b) for a, b in combinations(own, 2) if 100 * len(own[a] & own[b]) >= 80 * len(own[a] | own[b])}


def test_nothing_is_ranked_without_crowds(spark, monkeypatch):
    texts = [(k, " ".join(f"w{k // 2}x{i}" for i in range(60 + k % 2))) for k in range(40)]
    ranked = []
    monkeypatch.setattr(jaccard, "rare_first_pairs", lambda *a, plain=jaccard.rare_first_pairs: ranked.append(a) or plain(*a))
    got = jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert dict(got) == {k: k - k % 2 for k in range(40)} and not ranked


def test_template_documents(spark):
    """Documents of one template that differ too much to be linked meet in no pair, however many there are."""
    base = [f"w{i}" for i in range(96)]
    texts = [(k, " ".join([*base, *(f"u{k}x{j}" for j in range(12))]), k) for k in range(60)]
    assert jaccard.rare_first_pairs(spark.createDataFrame(texts, "id long, text string, c long"), "bigint", 5, 0.8).count() == 0
    assert spark.createDataFrame(texts, "doc_id long, text string, c long").transform(lambda d: jaccard.jaccard_components(d, threshold=0.85)).where("doc_id <> component_id").isEmpty()
    with pytest.raises(ValueError):
        jaccard.jaccard_components(spark.createDataFrame(texts, "doc_id long, text string, c long"), threshold=0.5)


@pytest.mark.parametrize("passes", [400_000, 300, 40])
def test_decontamination(spark, documents, odd, passes):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = defaultdict(set)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    for r in bench.collect():
        w = re.findall(pattern, lower(r.text or ""))
        for i in range(max(len(w) - 12, 1) if w else 0):
            windows[tuple(w[i : i + 13])].add(str(r.item_id))
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r.search for r in decontaminate(docs, bench, pass_words=passes).collect()}
    sizes = {len(w) for w in windows}
    for k, text in documents.items():
        w = re.findall(pattern, lower(text))
        hit, items = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (found := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    items |= found
        assert (got[k].n_words, got[k].n_hit, list(got[k]["items"])) == (len(w), len(hit), sorted(items))
    assert decontaminate(odd, bench).count() == odd.count()
    assert decontaminate(odd, bench.where("false")).agg(F.sum("search.n_hit")).first()[0] == 0
    assert decontaminate(odd.where("false"), bench).count() == 0


def test_toxicity(spark, odd):
    sf = "/root/testdata/sf0.1"
    labels = dict(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic").collect())
    rows = [r for r in QUERIES["op5_toxicity"](spark, sf).collect() if r.held_out and r.doc_id in labels]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and 0 <= r.score <= 1 for r in rows)
    right = Counter((labels[r.doc_id], r.predicted == labels[r.doc_id]) for r in rows)
    assert right[1, True] > 0.8 * (right[1, True] + right[1, False]) and right[0, True] > 0.95 * (right[0, True] + right[0, False])
    assert toxicity.score(odd, toxicity.Model()).where("toxicity.score < 0.5").count() == odd.count()
    rows = QUERIES["op5_toxicity"].__globals__["held_out"]()
    assert odd.select(rows.alias("h")).where("h is null").isEmpty()
    assert toxicity.fit(odd, spark.createDataFrame([], "doc_id long, toxic int")).slope == 0


def test_segments():
    import random
    import time

    import numpy as np

    found = toxicity.segments(np.array([4, -5, 3, -3, 1, 2, -2, 2, -2, 1, 5.0]), 0.0)
    assert sorted(found) == [(3.0, 2, 2), (4.0, 0, 0), (7.0, 4, 10)]

    def best(x, a, b):
        """All maximal segments by definition: the best one, then those left and right of it."""
        most = max(((sum(x[i : j + 1]), i - j, -i, j) for i in range(a, b) for j in range(i, b)), default=(0,))
        if most[0] <= 0:
            return []
        i, j = -most[2], most[3]
        return [*best(x, a, i), (float(most[0]), i, j), *best(x, j + 1, b)]

    draw = random.Random(1)
    for _ in range(200):
        x = [draw.choice([-3.25, -2.5, -1.125, 1.0, 2.75, 4.5]) + draw.randrange(1000) / 2**20 for _ in range(draw.randrange(1, 25))]
        assert sorted(toxicity.segments(np.array(x), 0.0)) == sorted(best(x, 0, len(x)))
    falling = np.tile([1.0, -1.5], 80_000) - np.linspace(0, 0.1, 160_000)
    began = time.process_time()
    assert len(toxicity.segments(falling, 0.0)) == 80_000 and time.process_time() - began < 5


def test_many_segments_count_alike(spark):
    """The statistic of the calibration is that of the scores, with any number of segments in a text."""
    import numpy as np
    import pyarrow as pa

    texts = ["bad ok ok ok " * 300, "ok " * 500, "", None]
    keys = np.array([toxicity.features(pa.array([w]))[1][-1][0] for w in ("bad", "ok")], np.uint64)
    order = np.argsort(keys)
    model = toxicity.Model(keys[order], np.array([3.0, -2.0])[order], 1.0, 0.0, 1.0, -4.0)
    words, levels = toxicity.features(pa.array(texts))
    found = toxicity.Found.of(words, model.word_scores(levels))
    assert np.diff(found.to).tolist() == [300, 0, 0, 0]
    model.ln_k = -8.0
    excess = 2.9 + 8 - np.log(1200)
    want = [np.sqrt(300 * excess) + np.tanh(excess / 4), -1, -1, -1]
    assert model.evidence(words.counts(), found) == pytest.approx(want)
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, toxicity string")
    got = {r.doc_id: r.t for r in toxicity.score(df, model, out="t").collect()}
    assert [got[k].score for k in range(4)] == pytest.approx([1 / (1 + np.exp(4 - w)) for w in want]) and len(got[0].passages) == (300 if excess > -np.log(0.01) else 0)
    with pytest.raises(ValueError):
        toxicity.score(df, model)


@pytest.fixture(scope="module")
def forest(spark):
    return secrets.train(secrets.labelled_findings(spark))


def test_forest(spark, forest):
    held = secrets.judge(secrets.labelled_findings(spark, 2000, seed=99), forest)
    right = Counter((r.label, (r.probability >= 0.5) == (r.label == 1)) for r in held.select("label", "probability").collect())
    assert all(right[k, True] >= 0.93 * (right[k, True] + right[k, False]) for k in (0.0, 1.0))


def test_plan_of_labelled_findings_is_small(spark):
    made = secrets.labelled_findings(spark)
    assert len(made._jdf.queryExecution().analyzed().toString()) < 30_000 and len(made._jdf.queryExecution().optimizedPlan().toString()) < 40_000
    rows = made.select(F.xxhash64(*made.columns).alias("h")).agg(F.count("*"), F.bit_xor("h")).first()
    assert tuple(rows) == (7999, 4413342042813863454)


def test_spans_of_candidates(spark):
    """Tokens and starts against a plain search, with more candidates than a block holds."""
    texts = ["é " + " ".join(f"w{i} password={'x' * (i % 9)}é{i:08d}z. id{i:012d}" for i in range(200)), None, "", "no candidate", "key: foundation of it", "token=short"]
    df = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    got = sorted((r.n, r.no, r.start, r.token) for r in secrets.candidates(df, ["n"]).collect())
    want = []
    for m in re.finditer(r"password=([^\s.]+)|(?<= )(id\d{12})", texts[0]):
        token = m[1] or m[2]
        want.append((0, len(want), m.end() - len(token), token))
    assert got == [*want, (4, 0, 5, "foundation")]


def test_secrets(spark, odd, forest):
    key = "ghp_" + "a1B2c3D4" * 4 + "e5F6"
    docs = odd.unionByName(spark.createDataFrame([(9, f'è token = "{key}" and order 2024-11-12T10:11, {key}nothing/to/find/{key}', 1, "z")], odd.schema))
    found = secrets.find_secrets(docs, forest).where("start < 20").collect()
    assert [(r.doc_id, r.start, r.token) for r in found] == [(9, 11, key)]
    clean = secrets.redact(docs, forest, changed="c")
    assert clean.count() == docs.count() and clean.where("c").first().text.startswith('è token = "[secret]" and order 2024-11-12T10:11,')
    assert secrets.redact(docs.where("false"), forest).count() == 0
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.where("not c").collect()) == sorted((r.doc_id or 0, r.text or "") for r in odd.collect())


def test_recall_of_planted_secrets(spark, forest):
    """Of secrets planted into documents in many forms at least nine tenths are found, and little else."""
    import random

    draw = random.Random(5)
    kinds = {
        "hex": lambda: "".join(draw.choices("0123456789abcdef", k=draw.choice([32, 40, 64]))),
        "mixed": lambda: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=32)),
        "capitals": lambda: "".join(draw.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ", k=24)),
        "small": lambda: "".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=24)),
        "short": lambda: "".join(draw.choices("ABCDEFGHJKLMNPabcdefghjkmnp23456789", k=8)) + draw.choice("!#$%") + draw.choice("0123456789"),
    }
    forms = ["password={}", 'password="{}"', "export SECRET_KEY={}", "token={}", 'api_key="{}"', "secret: {}", 'auth_token = "{}"']
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    planted = {}
    for k, doc in enumerate(sorted(texts)):
        kind, form = list(kinds)[k % len(kinds)], forms[k % len(forms)]
        value = kinds[kind]()
        words = texts[doc].split(" ")
        at = draw.randrange(len(words) + 1)
        texts[doc] = " ".join([*words[:at], form.format(value), *words[at:]])
        planted[doc] = (value, kind, form)
    found = defaultdict(dict)
    for r in secrets.find_secrets(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), forest).collect():
        found[r.doc_id][r.start] = r.token
        assert texts[r.doc_id][r.start : r.start + len(r.token)] == r.token
    hit, of, extra = Counter(), Counter(), 0
    for doc, (value, kind, form) in planted.items():
        got = value in found[doc].values()
        for group in (kind, form):
            of[group] += 1
            hit[group] += got
        extra += sum(t != value and not re.search(r"[0-9a-f]{32}", t) for t in found[doc].values())
    assert all(hit[g] >= 0.9 * of[g] for g in of), {g: (hit[g], of[g]) for g in of}
    assert extra <= 0.05 * len(planted)


def test_fingerprints(spark, documents):
    got = {r.doc_id: r for r in compare_with_next(spark.createDataFrame(list(documents.items()), "doc_id long, text string")).collect()}
    ids, by_text = sorted(documents), {}
    bag = lambda t: Counter(t.split()) or Counter([""])
    error = []
    for k, after in zip(ids, [*ids[1:], ids[0]], strict=True):
        t, half = documents[k], len(documents[k]) // 2
        made = t[: len(t) - half] + documents[after][:half]
        assert (got[k].n_chars, got[k].edited_sha256) == (len(t), sha(made))
        assert by_text.setdefault(t, got[k].fingerprint) == got[k].fingerprint
        if re.fullmatch(r"[^\x1c-\x1f\x85\xa0  -     　]*", t + made):
            a, b = bag(t), bag(made)
            error.append(got[k].near_edited - sum((a & b).values()) / sum((a | b).values()))
    assert abs(sum(error) / len(error)) < 0.02 and sum(e * e for e in error) / len(error) < 0.01


def test_fingerprints_of_long_texts(spark):
    """Many different words don't make texts alike."""
    texts = [" ".join(f"{side}{i}" for i in range(20_000)) for side in "ab"] + [" ".join(f"{'a' if i % 2 else 'c'}{i}" for i in range(20_000))]
    got = {r.doc_id: r for r in compare_with_next(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0].near_next < 0.05 and got[1].near_next < 0.05 and abs(got[2].near_next - 1 / 3) < 0.2


def test_rows_of_repeated_words(spark, capsys):
    """A repeated word has a row for each lot of samples, not for each sample, and no generated method is too large for the JVM to compile."""
    made = fingerprint.ranked_terms(spark.createDataFrame([(1, "a b a c a")], "doc_id long, text string"), ["doc_id"])
    assert made.where("_lot < 0").count() == 2 and made.where("_lot >= 0").count() <= 64 / 2
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else there is no code before the run
    try:
        fingerprint.fingerprints(spark.read.parquet(f"{SF}/documents.parquet").repartition(3, "doc_id"), ["doc_id"]).explain("codegen")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000


def test_fingerprints_of_odd_rows(spark, odd):
    """Null and repeated ids, null and empty texts, equal rows, a clashing column, an empty table and a single row."""
    got = compare_with_next(odd).collect()
    assert len(got) == odd.count()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append(r)
    assert {k: len(v) for k, v in by_id.items()} == {None: 1, 1: 1, 2: 1, 3: 1, 4: 2, 5: 1, 6: 1}
    assert by_id[1][0].fingerprint == by_id[2][0].fingerprint == by_id[3][0].fingerprint and by_id[1][0].near_next == 1
    assert sorted(r.near_next == 1 for r in by_id[4]) == [False, True] and {r.fingerprint for r in by_id[4]} == {by_id[4][0].fingerprint}
    assert {r.edited_sha256 for r in by_id[4]} == {sha("one one"), sha("one wör")} and by_id[6][0].edited_sha256 == sha("ONE one")
    assert by_id[None][0].edited_sha256 == sha("one two") and by_id[None][0].n_chars == 13
    assert compare_with_next(odd.where("false")).count() == 0
    one = compare_with_next(spark.createDataFrame([(3, "a b c d")], "doc_id long, text string")).first()
    assert one.near_next == 1 and one.edited_sha256 == sha("a b a b"[:4] + "a b")


def test_repeated_units(spark, odd):
    one = "The quick brown fox jumps over dogs."
    docs = spark.createDataFrame([(1, f"É one. {one} More of it here and there now."), (2, f"{one.upper()} {one} Short one."), (3, None), (4, "")], "doc_id long, text string")
    gone = lines.repeated_units(docs)
    assert sorted((r.doc_id, r.unit_no, r.start, r.end, r.n_words, r.kept_in) for r in gone.collect()) == [(2, 0, 0, 36, 7, 1), (2, 1, 36, 73, 7, 1)]
    left = dict(lines.without_repeats(docs, gone).collect())
    assert left == {1: f"É one. {one} More of it here and there now.", 2: " Short one.", 3: None, 4: ""}
    assert lines.repeated_units(odd, least=6).count() == 0 and lines.repeated_units(odd.where("false")).count() == 0
    assert [(r.doc_id, r.kept_in) for r in lines.repeated_units(odd).collect()] == [(6, 4)]


def brute_units(texts, unit):
    """Units to remove by a plain scan: each one's document, number, span, and the document that keeps it."""
    ends = {"line": r"\n", "paragraph": r"\n\n(?!\n)", "sentence": r"\n|[.!?](?=[ \t\r])"}[unit]
    first, seen, gone = {}, set(), []
    for k in sorted(texts):
        t, at, no = texts[k], 0, 0
        for end in [*(m.end() for m in re.finditer(ends, t)), len(t)]:
            key = tuple(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t[at:end])))
            if key:
                if key in seen:
                    gone.append((k, no, at, end, first[key]))
                seen.add(key)
                first.setdefault(key, k)
            at, no = end, no + 1
    return gone


@pytest.mark.parametrize("unit", ["line", "paragraph", "sentence"])
def test_units_against_a_plain_scan(spark, documents, unit):
    texts = documents | {-1: "Á b.\n\nB c\n\n\nB c! B c", -2: "Á b.\n\nb, C\n\nn"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = lines.repeated_units(df, unit=unit)
    rows = sorted((r.doc_id, r.unit_no, r.start, r.end, r.kept_in) for r in got.collect())
    want = sorted(brute_units(texts, unit))
    assert rows == want
    left = dict(lines.without_repeats(df, got).collect())
    for k, t in texts.items():
        for _, _, a, b, _ in sorted((w for w in want if w[0] == k), reverse=True):
            t = t[:a] + t[b:]
        assert left[k] == t


def test_short_repeated_units(spark, tmp_path, monkeypatch):
    """The query removes repeats of any length, also those within a text."""
    rows = [(1, "Les.\nA line of its own, not said twice."), (2, "les\nAnd ornd. Les!"), (3, "And ornd.\n--\nNew."), (4, "--\n...")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for hot in (lines.HOT, 2):
        monkeypatch.setattr(lines, "HOT", hot)
        gone = QUERIES["op10_repeated_units"](spark, str(tmp_path)).collect()
        assert sorted((r.doc_id, r.unit_no, r.n_words, r.kept_in) for r in gone) == [(2, 0, 1, 1), (2, 2, 1, 1), (3, 0, 2, 2)]


def test_scores_and_revisits_of_odd_rows(spark, odd):
    made = scoring.backoff_scores(odd)
    assert made.count() == odd.count() and made.where("lm_words = 0 and lm_score is null").count() == 3
    assert scoring.backoff_scores(odd.where("false")).count() == 0
    schema = "record_id string, url string, time long, status int, headers map<string,string>"
    records = [("r1", "http://www.A.com/x/?b=2&a=1#f", 1, 200, {"ETag": '"t"', "Content-Length": "5", "Server": "s"}), ("r2", None, 2, 200, None), ("v1", "https://a.com/x?a=1&b=2&utm_source=z", 3, 304, {"etag": 'W/"t"', "content-length": "0", "Date": "d"}), ("v2", "https://a.com/x?a=1&b=2", 1, 304, {}), ("v3", None, 9, 304, {}), ("v4", "a.com/x?a=1&b=2", None, 304, {})]
    got = {r.record_id: r for r in warc.resolve_revisits(spark.createDataFrame(records, schema)).collect()}
    assert {k: r.outcome for k, r in got.items()} == {"v1": "resolved", "v2": "no response", "v3": "unchecked", "v4": "no response"}
    assert got["v1"].headers == {"etag": 'W/"t"', "content-length": "5", "server": "s", "date": "d"}
    assert warc.resolve_revisits(spark.createDataFrame([], schema)).count() == 0


def test_components_of_stars_take_no_round(spark, monkeypatch):
    """Rounds end as soon as the edges are stars, so that few queries run one after the other on the driver."""
    written, own = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: written.append(1) or own(df))
    stars = spark.createDataFrame([(1, 5), (9, 1), (1, 9), (2, 7), (3, 3), (None, 4)], "a long, b long")
    assert sorted(map(tuple, graph.components(stars).collect())) == [(1, 1), (2, 2), (5, 1), (7, 2), (9, 1)] and len(written) == 1
    path = spark.createDataFrame([(k * 7 % 20, (k + 1) * 7 % 20) for k in range(19)] + [(30, 40), (40, 31)], "a long, b long")
    assert sorted(map(tuple, graph.components(path).collect())) == [*((k, 0) for k in range(20)), (30, 30), (31, 30), (40, 30)]
    assert graph.components(stars.where("false")).count() == 0


def test_pipeline_of_odd_rows(spark, odd):
    """Stages on nulls, empty, repeated and long texts, with columns named like their own and without ``n_chars``."""
    docs = odd
    for name in ("_toxicity", "_search", "_changed", "repetition", "mix_size"):
        docs = docs.withColumn(name, F.lit(name))
    want = sorted((r.doc_id or 0, r.text or "") for r in odd.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        rows = sorted((r.doc_id or 0, r.text or "") for r in kept.collect())
        assert rows == ([x for x in want if x[0] != 6] if name == "near duplicates" else want), name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.columns == [*docs.columns, "_repetition"] and mixed.where("mix_size <> 'mix_size' or repetition <> 'repetition'").isEmpty() and mixed.count() > 0


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns, name
        assert kept.select("doc_id").subtract(docs.select("doc_id")).isEmpty()
        docs = spark.createDataFrame(kept.collect(), docs.schema)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() > 0 and sorted(r.doc_id for r in last.collect()) == sorted(r.doc_id for r in corpus_pipeline.run(spark, SF).collect())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), SF).count() == 0
