"""Operators against brute force on small tables with nulls, ties, repeats and long texts."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.llm import decontaminate, exactdedup, graph, langid, linededup, ngramjoin, packing, pii, suffixdedup, toxicity, urlfilter
from tsengine.llm.queries import public_vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, key string"


def texts(seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line = "A common line that is long enough to count, " + prose(5)
    base = prose(120)
    rows = [None, "", " \t\n", "one two", "one  TWO", base, base + " ", base.upper(), base]
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows += [prose(40) + "\n  " + line + " \n" + prose(40) for _ in range(7)]
    rows += [prose(rng.randint(1, 80)) for _ in range(20)] + [prose(9000)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", "clash") for i, t in enumerate(texts())]
    rows += [rows[5], (None, rows[6][1], None, None, None)]  # a repeated row, a null doc_id
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(docs):
    return docs.filter("doc_id is not null").dropDuplicates(["doc_id"])


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def plain(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_exact_dedup(docs, empty):
    rows = exactdedup.exact_dedup(docs, 0.05).collect()
    assert len(rows) == docs.count() and exactdedup.exact_dedup(empty).count() == 0
    by = {}
    for r in docs.select("doc_id", "text").collect():
        by.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), []).append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    want = {hashlib.sha256(k.encode()).hexdigest(): (min(v)[2], len(v)) for k, v in by.items()}
    assert all((r.keep_id, r.group_size) == want[r.text_sha256] for r in rows)
    assert sum(r.kept for r in rows) == len(by)


def test_line_dedup(unique, docs, empty):
    got = {r.doc_id: r for r in linededup.apply_keep_bitmaps(unique, linededup.line_keep_bitmaps(unique)).collect()}
    all_, held = plain(unique), {}
    key = lambda x: re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r"))
    for d, t in all_.items():
        for x in t.split("\n"):
            held.setdefault(key(x), set()).add(d)
    for d, t in all_.items():
        keep = [x for x in t.split("\n") if len(key(x)) < 40 or len(held[key(x)]) < 5 or max(held[key(x)]) == d]
        assert (got[d].text or "") == "\n".join(keep) and got[d].n_lines == t.count("\n") + 1
    assert linededup.apply_keep_bitmaps(docs, linededup.line_keep_bitmaps(docs)).count() == docs.count()
    assert linededup.apply_keep_bitmaps(empty, linededup.line_keep_bitmaps(empty)).count() == 0


@pytest.mark.parametrize("block", [ngramjoin.BLOCK, 4])  # lists of one block and of several
def test_jaccard_components(unique, docs, empty, block, monkeypatch):
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    sets = {}
    for d, t in plain(unique).items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    label = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
        if all(label[label[d]] == label[d] for d in label):
            break
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngramjoin.jaccard_components(unique).collect()}
    assert got == {d: (len(sets[d]), label[d]) for d in sets}
    assert ngramjoin.jaccard_components(docs).count() == docs.count()
    assert ngramjoin.jaccard_components(empty).count() == 0


@pytest.mark.parametrize("block", [ngramjoin.BLOCK, 8])
def test_jaccard_components_between_map_tasks(spark, block, monkeypatch):
    """A text and many versions with two edits lie in one map task, which holds their tokens
    often; versions with one edit lie in others, similar to the text but not to most leaders."""
    monkeypatch.setattr(ngramjoin, "BLOCK", block)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    edited = lambda w, at: " ".join(word() if i in at else x for i, x in enumerate(w))
    parts = [[], [], []]
    for _ in range(8):
        w = [word() for _ in range(100)]
        parts[0] += [edited(w, ())] + [edited(w, (a, a + 9 + rng.randrange(40))) for a in (rng.randrange(10, 45) for _ in range(30))]
        for part in parts[1:]:
            part.append(edited(w, (rng.randrange(10, 90),)))
    rng.shuffle(parts[0])
    for _ in range(3):  # versions that drift: each is similar to the next ones only
        w = [word() for _ in range(120)]
        for k in range(40):
            w = w[:]
            w[rng.randrange(120)] = word()
            parts[k % 3].append(" ".join(w))
    # One text shares a token with many, but is similar to one only, which lies elsewhere.
    w = [f"w{k}" for k in range(1, 9)]
    parts[1] += [" ".join([*w, "uniq"])] + [" ".join([*w[:5], *(word() for _ in range(4))]) for _ in range(6)]
    parts[2] += [" ".join(w)] + [" ".join([word(), *w[a:]]) for a in (1, 2, 3) for _ in range(8)]
    rows = list(enumerate(sum(parts, [])))
    cuts = np.cumsum([0, *map(len, parts)])
    df = spark.createDataFrame(spark.sparkContext.parallelize([rows[a:b] for a, b in zip(cuts, cuts[1:])], 3).flatMap(lambda x: x), "doc_id long, text string")
    sets = [set(zip(*(t.split()[i:] for i in range(5)))) for _, t in rows]
    label, links = list(range(len(rows))), [(a, b) for a in range(len(rows)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(df).collect()}
    assert got == dict(enumerate(label))


def test_divide_skip():
    rng = random.Random(3)
    for _ in range(300):
        lists = [sorted(rng.sample(range(30), rng.randint(1, 30))) for _ in range(rng.randint(1, 20))]
        t = rng.randint(1, len(lists))
        n = Counter(x for y in lists for x in y)
        assert ngramjoin.divide_skip(lists, t) == {x: c for x, c in n.items() if c >= t}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in graph.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def repeated_bytes(rows):
    """doc_id: (n_bytes, n_removed, n_spans, sha256), straight from the definition."""
    seen = Counter(b[i : i + 200] for _, b in rows for i in range(len(b) - 199))
    out = {}
    for d, b in rows:
        gone = np.zeros(len(b) + 2, bool)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i + 1 : i + 201] = True
        spans = int((gone[1:] & ~gone[:-1]).sum())
        out.setdefault(d, []).append((len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone[1:-1]].tobytes()).hexdigest()))
    return {d: sorted(x) for d, x in out.items()}


def suffix_texts():
    rng = random.Random(8)
    prose = lambda n: " ".join("".join(rng.choice("abcdefé") for _ in range(rng.randint(1, 6))) for _ in range(n))
    passages = [prose(90) for _ in range(3)] + ["x" * 260, "ab" * 150]
    rows = [None, "", "short", "y" * 199, "z" * 200, "z" * 201, prose(20)]
    for _ in range(60):  # passages cut anywhere, in contexts of their own
        p = rng.choice(passages)
        a, b = sorted(rng.sample(range(len(p)), 2))
        rows.append(prose(rng.randrange(40)) + rng.choice([p, p[a:], p[a:b]]) + prose(rng.randrange(40)) + rng.choice(passages)[:230])
    base = prose(300)
    for _ in range(20):  # near and exact copies
        at = rng.randrange(len(base))
        rows += [base[:at] + "#" + base[at + 1 :], base]
    rows.append(prose(6000) + base + prose(10) + base)
    return rows


@pytest.mark.parametrize("bucket", [suffixdedup.BUCKET, 300])  # one range, and many with splitters
def test_suffix_dedup(spark, unique, docs, empty, bucket, monkeypatch):
    monkeypatch.setattr(suffixdedup, "BUCKET", bucket)
    rows = list(enumerate(suffix_texts())) + [(9, "again " * 50), (9, "again " * 50), (None, "q" * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("k1", "starts", "n_bytes", "kept", "lo")}).repartition(5)
    for table in (df, unique, docs):
        want = repeated_bytes([(r.doc_id, (r.text or "").encode()) for r in table.select("doc_id", "text").collect()])
        got = {}
        for r in suffixdedup.suffix_dedup(table).collect():
            got.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256))
            assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256
        assert {d: sorted(x) for d, x in got.items()} == want
    assert suffixdedup.suffix_dedup(empty).count() == 0


def test_multikey_quicksort():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 50, 3000):
        keys = rng.integers(0, 3, (n, 6)).astype(np.uint64)
        order, differs = suffixdedup.multikey_quicksort(n, 6, lambda k, d: keys[k, d])
        rows = [tuple(x) for x in keys[order].tolist()]
        assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
        assert differs.tolist() == [i == 0 or rows[i] != rows[i - 1] for i in range(n)]


def test_contamination(spark, empty):
    item = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(1, "x " + item.upper() + " y"), (2, "a " + " ".join(item.split()[3:16])), (3, " ".join(item.split()[:12])), (4, None), (5, "tiny item here")], "doc_id long, text string")
    items = spark.createDataFrame([(10, item), (9, "tiny ITEM"), (8, None), (7, "--")], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (22, 20, ["10"]), 2: (14, 13, ["10"]), 3: (12, 0, []), 4: (0, 0, []), 5: (3, 2, ["9"])}
    assert decontaminate.contamination(empty, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).filter("n_hit > 0").count() == 0


def test_url_verdicts(spark):
    urls = ["http://a.ORG/x", "https://example.org/es/1?q", "x://b.example.org/en/12", "http://t.com/de/", "http://forg/", None, "nothing", "http://bad.net/p.html#x"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string")
    listed = spark.createDataFrame([("bad.net/p",), (None,)], "canonical string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.url_verdicts(pages, listed).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1][2:] == ("example.org/es/", "block") and got[2][2:] == ("example.org/en/1", "block")
    assert got[3][2:] == ("com/de/", "block") and got[4][2:] == (None, "allow") and got[5] == got[6] == ("", "", None, "allow") and got[7] == ("bad.net", "/p.html", None, "block")


def test_packing_round_trip(unique, empty):
    voc = public_vocabulary()
    tok = packing.Tokens(**voc)
    slow = packing.Tokens(voc["vocabulary"], None, None)
    assert (tok.ids("a <|endoftext|> b") == slow.ids("a <|endoftext|> b")).all()
    rows = packing.packed_sequences(unique, **voc).collect()
    pieces, seqs = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r["ids"], "<u4")))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for d, t in plain(unique).items():
        assert (np.concatenate([x for _, x in sorted(pieces[d], key=lambda p: p[0])]) == slow.ids(t)).all()
    for v in seqs.values():
        ends = np.cumsum([n for _, n in sorted(v)])
        assert [o for o, _ in sorted(v)] == [0, *ends[:-1]] and ends[-1] <= 1024
    assert packing.packed_sequences(empty, **voc).count() == 0


def test_pii_discovers_by_context(spark, empty):
    rows = [(i, f"Please call us at +1 (555) 010-{1000 + i} or write to user{i}@mail.example.com today") for i in range(30)]
    rows += [(99, "Please call us at 555-0199 now"), (100, None), (101, "the 555-0199 thing")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[99].spans] == [(3, 18, 26)] and got[99].base == [] and got[100].spans == [] and got[101].spans == []
    assert [s.kind for s in got[0].base] == [0, 3]
    assert pii.personal_data(empty).count() == 0


def test_pii_takes_a_second_step(spark):
    rows = [f"Please call us at +1 (555) 010-{1000 + i} today" for i in range(60)]
    rows += [f"Please call us at 555-{2000 + i} now" for i in range(20)]
    rows += [f"or reach me on 555-{2000 + i} then" for i in range(20)] + ["or reach me on 555-7777 then", "unlike page no 555-7777 then"]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(got[i] == [(3, 18, 26)] for i in range(60, 80)) and all(got[i] == [(3, 15, 23)] for i in range(80, 101)) and got[101] == []


def test_pii_goes_on_until_nothing_is_new(spark):
    """Contexts that are four steps from the only one with seeds."""
    said = ["Please call us at", "or reach me on", "else ask him by", "and find them under", "his own line is"]
    rows = [f"{said[0]} +1 (555) 010-{1000 + i} today" for i in range(200)]
    for step in range(4):  # what two contexts share
        rows += [f"{said[k]} 555-{step}{100 + i} now" for i in range(40) for k in (step, step + 1)]
    rows += [f"{said[4]} 555-7777 now", "unlike page no 555-7777 then"]
    got = {r.doc_id: r.spans for r in pii.personal_data(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert all(len(got[i]) == 1 for i in range(200, len(rows) - 1)) and got[len(rows) - 1] == []


def test_pii_joins_what_it_does_not_broadcast(spark, monkeypatch):
    rows = [(i, f"{'Please call us at' if i % 2 else 'you may reach me on'} +1 (555) 010-{1000 + i} today") for i in range(60)]
    rows += [(99, "or call us at 555-0199, or reach me on 555-0198"), (99, "or call us at 555-0199, or reach me on 555-0198"), (None, "reach me on 555-0197"), (100, None), (101, "the 555-0199 thing")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    run = lambda: sorted(((r.doc_id, [tuple(s) for s in r.base], [tuple(s) for s in r.spans]) for r in pii.personal_data(df).collect()), key=str)
    want = run()
    assert want.count((99, [], [(3, 14, 22), (3, 39, 47)])) == 2 and (None, [], [(3, 12, 20)]) in want and len(want) == len(rows)
    monkeypatch.setattr(pii, "MAX_PATTERNS", 1)
    assert run() == want


def test_pii_counts_whole_instances(spark):
    rows = [(i, f"please write to {'x' * 70}{i}@mail.example.com today") for i in range(30)] + [(99, "please write to 555-0199 today")]
    got = {r.doc_id: r for r in pii.personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[99].spans] == [(0, 16, 24)]


def test_toxicity_and_language(spark, empty):
    rng = random.Random(5)
    rows = []
    for i in range(400):
        toxic = i // 2 % 4 == 0  # in both languages alike
        w = [rng.choice(["der", "und", "nicht", "haus"] if i % 2 else ["the", "and", "not", "house"]) for _ in range(60)]
        if toxic:
            w[5::7] = ["scumbag"] * len(w[5::7])
        rows.append((i, " ".join(w), "de" if i % 2 else "en", int(toxic)))
    rows.append((None, None, None, None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")
    scored = toxicity.toxicity(df, df.select("doc_id", "toxic"), ["doc_id", "toxic"]).collect()
    assert all((r.score >= 0.5) == bool(r.toxic) for r in scored if r.toxic is not None) and all(0 <= r.score <= 1 for r in scored)
    lang = {r.doc_id: r.lang_pred for r in langid.language(df).collect()}
    assert all(lang[i] == x for i, _, x, _ in rows if i is not None) and lang[None] == "und"
    assert toxicity.toxicity(empty, df.select("doc_id", "toxic")).count() == 0 and langid.language(empty).count() == 0


def test_maximal_segments_hold_the_best_sum():
    rng = np.random.default_rng(2)
    for _ in range(300):
        x = rng.normal(-0.3, 1, rng.integers(1, 25))
        best = max((x[a:b].sum() for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=0)
        found = toxicity.maximal_segments(x)
        assert not found and best <= 0 or abs(max(f[2] for f in found) - best) < 1e-9


def test_bloom_filter_has_no_false_negatives(spark):
    listed = spark.range(2000).select(F.concat(F.lit("h/"), "id").alias("canonical"))
    pages = listed.select(F.col("canonical").alias("page_id"), F.concat(F.lit("http://"), "canonical").alias("url"))
    assert urlfilter.url_verdicts(pages, listed, []).filter("verdict = 'block'").count() == 2000
