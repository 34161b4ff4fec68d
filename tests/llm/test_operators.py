"""Each operator against the library it must equal, a brute-force version, or its SQL."""

import functools
import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as public
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash

from sentivane.llm import (
    components, ctw, packing, quality, quotes, sentencepiece_bpe, simhash, syncmers, token_files,
    toxicity, urls,
)
from sentivane.session import new_path

PIECES = public.path("piece_bpe_32k.model")
WORDS = public.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977} of" for i in range(9000))
TEXTS = [
    (1, "The quick brown fox, jumps over 12 dogs.\nNew\tline  here "), (2, None), (3, ""),
    (4, " \t\n\x0b "), (5, "é 漢字 😀 ﬁ ▁mark <0x0A> <|endoftext|> it's J\u030c"), (6, LONG),
    (7, "same text here again and again"), (8, "same text here again and again"),
    (8, "same text here again and again"), (None, "no id at all"), (-3, "A"),
]
# columns whose names meet those the operators make themselves
EXTRA = "doc_id long, text string, id long, key string, fp string, block int, ids string, n int"


def frame(spark, rows=None, schema="doc_id long, text string"):
    return spark.createDataFrame(TEXTS if rows is None else rows, schema)


def extra(spark):
    return frame(spark, [(*r, 7, "k", "f", 1, "x", None) for r in TEXTS], EXTRA)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def corpus(n=60, seed=3):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "And", "tion", "erre", "ndou", "theatre", "on,", "by.", "rewh"]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 80)))
        out.append((i * 3, text))
    return out


# 1. SentencePiece ---------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def test_encoding_and_decoding_equal_the_library(spark, library):
    got = rows_of(sentencepiece_bpe.digests(frame(spark), PIECES))
    want = []
    for doc, text in TEXTS:
        ids = library.encode(text or "") + [2]
        want.append((doc, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert got == rows_of(sentencepiece_bpe.digests(extra(spark), PIECES))
    ids = sentencepiece_bpe.encode(frame(spark), PIECES)
    back = {(r["id"], r["text"]) for r in sentencepiece_bpe.decode(ids, PIECES).collect()}
    assert (1, TEXTS[0][1]) in back and (6, LONG) in back


def test_random_strings_encode_like_the_library(library):
    p = sentencepiece_bpe.pieces(PIECES)
    rng = random.Random(5)
    known = list(p.id_of)
    for k in range(4000):
        if k % 3:
            s = "".join(rng.choice(known).replace("▁", rng.choice(" ▁")) for _ in range(5))
        else:
            s = "".join(rng.choice("aabbee  ▁'=<>0\n\té\u0301漢😀nthsri.,") for _ in range(30))
        assert p.encode(s) == library.encode(s), s
        ids = [rng.choice((rng.randrange(32000), rng.randrange(262))) for _ in range(6)]
        assert p.decode(ids) == library.decode(ids), ids


# 2. Quality ---------------------------------------------------------------------------------------

def plain_quality(text):
    t = (text or "").encode()
    w = t.split()
    tri = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    covered = {i + k for i, g in enumerate(tri) if n[g] > 1 for k in range(3)}
    lines = [x for x in t.split(b"\n") if x.split()]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return (len(w), sum(len(x.decode()) for x in w), sum(t.count(c) for c in b"#*$%&|<>"), dup,
            len(covered))


def test_quality_counts_and_verdict(spark):
    good = " ".join(f"word{i}" for i in range(60))
    rows = [*TEXTS, (20, good), (21, good + " # # # # # # #"), (22, good + " a b c a b c"),
            (23, "\n".join(["one line"] * 40)), (24, good.upper())]
    got = {(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
            r["n_repeat_words"]): (r["base_failed"], r["kept"])
           for r in quality.judge(frame(spark, rows)).collect()}
    for doc, text in rows:
        base = plain_quality(text)
        failed = base[0] < 50 or 100 * base[4] > 50 * base[0]
        assert got[(doc, *base)][0] == failed
        assert not (failed and got[(doc, *base)][1])
    kept = {k[0] for k, v in got.items() if v[1]}
    assert 20 in kept and 22 in kept and not kept & {21, 23, 24}


def test_quality_order_does_not_decide(spark):
    df = extra(spark)
    names = [r.name for r in quality.RULES]
    assert sorted(quality.plan(df)) == sorted(names)
    a = quality.judge(df, order=names)
    assert rows_of(a) == rows_of(quality.judge(df, order=names[::-1]))
    kept = quality.keep(frame(spark, [(20, " ".join(f"w{i}x" for i in range(60))), (3, "")]))
    assert [r["doc_id"] for r in kept.collect()] == [20]


# 3. Toxicity --------------------------------------------------------------------------------------

def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(300):
        w = [rng.choice(plain) for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            w[::10] = [rng.choice(["idiot", "scum!", "Moron"]) for _ in w[::10]][:len(w[::10])]
        docs.append((i, " ".join(w)))
        if i < 200:
            labels.append((i, 1, int(toxic)))
    docs += [(900, None), (901, ""), (None, "scum idiot moron idiot")]
    labels += [(None, 1, 1), (5, 1, None)]
    df = frame(spark, docs)
    model = toxicity.fit(df, frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert list(model.theta) == sorted(model.theta)
    got = {r["doc_id"]: r for r in toxicity.score(df, model).collect()}
    assert all(got[i]["toxic"] == (i % 3 == 0) for i in range(200, 300))
    assert not got[900]["toxic"] and got[None]["toxic"]
    assert all(0 <= r["severity"] <= toxicity.GRADES for r in got.values())
    left = {r["doc_id"] for r in toxicity.clean(df, model).collect()}
    assert left == {k for k, r in got.items() if not r["toxic"]}


def test_toxicity_without_labels(spark):
    none = frame(spark, [], "doc_id long, quality int, toxic int")
    model = toxicity.fit(frame(spark), none)
    assert all(r["severity"] == 0 and not r["toxic"]
               for r in toxicity.score(frame(spark), model).collect())


# 4. URLs ------------------------------------------------------------------------------------------

def test_url_parts_and_rules(spark):
    urls_of = [
        "http://A.Example.ORG/es/x?y#z", "https://example.org/en/1/2", "x.fr.com", None,
        "http://q.com/fr/1", "http://q.com/de/", "http://notorg/", "s://u.org?p", "http://org/es/",
    ]
    df = spark.createDataFrame([(i, u, None) for i, u in enumerate(urls_of)],
                               "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:] for r in urls.judge(df).collect()}
    assert got[0] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[1] == ("example.org", "/en/1/2", "example.org/en/1", "block")
    assert got[2] == ("", "", None, "allow") and got[3] == ("", "", None, "allow")
    assert got[4][2:] == ("com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert got[6] == ("notorg", "/", None, "allow")
    assert got[7] == ("u.org", "", None, "allow") and got[8][2:] == ("org/", "allow")


def test_decisions_reach_aliases(spark):
    rows = [
        (1, "http://a.net/x#top", "<link rel='canonical' href='http://b.example.org/es/1'>"),
        (2, "http://c.net/y", '<META content="0; URL=http://a.net/x" http-equiv="refresh">'),
        (3, "http://e.com/de/9", '<link href="//f.net/q?utm_a=1&b=2" rel=canonical>'),
        (4, "https://F.net/q/?b=2", ""), (4, "https://F.net/q/?b=2", ""),
        (5, "https://h.net/", "<link rel=canonical href=/k>"),
        (6, "https://h.net/k", "<link rel=canonical href=https://z.org/ok>"),
        (7, "https://h.net/m", "<link rel=canonical href=http://w.com/de/8>"
                               "<link rel=canonical href=/k>"), (None, None, None),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = defaultdict(set)
    for r in urls.judge(df).collect():
        got[r["page_id"]].add(r["verdict"])
    assert got == {1: {"block"}, 2: {"block"}, 3: {"block"}, 4: {"block"}, 5: {"allow"},
                   6: {"allow"}, 7: {"allow"}, None: {"allow"}}


def test_known_pages_and_written_slashes_decide(spark):
    """A page without a rule stays allowed when aliases lead to it; targets keep their slash."""
    schema = "page_id long, url string, html string, node string, host int, component string"
    link = "<link rel=canonical href='%s'>"
    rows = [(1, "http://x.com/de", link % "http://a.net/x"), (2, "http://a.net/x", None),
            (3, "http://b.net/y", link % "http://y.com/de/"), (4, "http://c.net/", link % "http://z.com/de"),
            (4, "http://c.net/", link % "http://z.com/de"), (5, "http://d.net/" + "a" * 50_000, "<p>")]
    df = spark.createDataFrame([(*r, "n", 1, "c") for r in rows], schema)
    got = {r["page_id"]: r["verdict"] for r in urls.judge(df).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "allow", 5: "allow"}
    assert urls.judge(df.limit(0)).count() == 0


def test_verdicts_equal_plain_closure(spark):
    """Random pages and links against a closure by hand."""
    rng = random.Random(21)
    hosts = ["a.org", "example.org", "b.com", "c.net", "d.net", "e.net", "f.net", "g.net"]
    address = lambda: "http://%s%s" % (rng.choice(hosts), rng.choice(
        ["/", "/es/1", "/en/12", "/fr/x", "/de/y", "/de", "/p%d" % rng.randrange(9)]))
    pages = [(i, address(), None if rng.random() < 0.4 else
              "<link rel='canonical' href='%s'>" % address()) for i in range(80)]

    def rule_of(url):
        host, _, path = url[7:].partition("/")
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host))
                and ("/" + path).startswith(r.path)]
        return max(fits, key=lambda r: len(r.name), default=None)

    node = lambda url: url[7:].rstrip("/")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    named = defaultdict(list)
    for _, url, html in pages:
        named[node(url)].append(url)
    known = set(named)
    for _, url, html in pages:
        if html:
            target = html.split("'")[3]
            root[find(node(url))] = find(node(target))
            if node(target) not in known:
                named[node(target)].append(target)
    marks = defaultdict(set)
    for n, us in named.items():
        marks[find(n)] |= {r.verdict for u in us if (r := rule_of(u))}
    want = {}
    for i, url, _ in pages:
        r, m = rule_of(url), marks[find(node(url))]
        want[i] = r.verdict if r else "block" if m == {"block"} else "allow"
    got = {r["page_id"]: r["verdict"] for r in urls.judge(spark.createDataFrame(
        pages, "page_id long, url string, html string")).collect()}
    assert got == want and set(want.values()) == {"allow", "block"}


def test_components_equal_brute_force(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 180)] + [(0, i) for i in range(300, 380)]
    edges += [(rng.randrange(500, 600), rng.randrange(500, 600)) for _ in range(60)]
    edges += [(5, 5), (None, 4), (101, 100)]
    label = {}

    def root(x):
        while label.setdefault(x, x) != x:
            x = label[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            label[max(a, b)] = min(a, b)
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    assert rows_of(got) == sorted(((x, root(x)) for x in label), key=repr)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5. Chat ------------------------------------------------------------------------------------------

NESTED = [
    (1, 1, "user", "first words"), (1, 2, "user", "> first words\nsecond words"),
    (1, 3, "user", "> second words\n>> first words\nthird"),  # the nearer level decides
    (1, 4, "user", ">> first words\nonly the inner quote is left"),
    (1, 5, "user", "> never said\n> > second words\n>>> first words\nfifth"),
    (1, 6, "user", ">> third\n\n>> second words\nlatest of one level"),
    (1, 7, "user", ">> never said\nno parent"), (2, 1, "user", ">> first words\nelsewhere"),
    (3, 1, None, None), (3, 2, "user", ">> \n>"),
]
PARENTS = {(1, 2): 1, (1, 3): 2, (1, 4): 1, (1, 5): 2, (1, 6): 3}


def test_nested_quotes_link_where_no_nearer_one_does(spark):
    df = spark.createDataFrame(NESTED, "conv_id long, turn long, role string, text string")
    got = quotes.conversations(df).collect()
    assert len(got) == len(NESTED)
    assert {(r["conv_id"], r["turn"]): r["parent_turn"] for r in got
            if r["parent_turn"] is not None} == PARENTS
    path = {(r["conv_id"], r["turn"]): list(r["reply_path"]) for r in got}
    assert path[1, 6] == [1, 2, 3, 6] and path[1, 7] == [7]


def test_sql_of_chat_links_nested_quotes_too(spark, tmp_path):
    import duckdb

    df = spark.createDataFrame(NESTED, "conv_id long, turn long, role string, text string")
    df.write.parquet(str(tmp_path / "c"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    names = ["conv_id", "turn", "role", "body", "max_level", "parent_turn", "reply_path"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({quotes.SQL}) ORDER BY 1, 2").fetchall()
    got = quotes.conversations(df).orderBy("conv_id", "turn").collect()
    assert [tuple(r) for r in got] == want


def test_quotes_link_to_their_origin(spark):
    rows = [
        (1, 0, "u", "Hello there\nHow  are you?\n\nSecond para"),
        (1, 1, "a", "> Hello there\n> how are you?\n\nFine\n>> deep\nthx"),
        (1, 2, "u", "> > Hello there\n> Fine\n\ngood"), (1, 3, "a", "> Second para\n>\n> good\nok"),
        (1, 4, "u", "> nothing like it\nok"), (1, 5, "u", "> ok\n again ok"),
        (2, 0, None, None), (2, 1, "x", "> Hello there\r\n"), (None, 3, "u", "> a\nb"),
        (3, 0, "u", "long " * 3000), (3, 1, "u", "> " + "long " * 3000 + "\nyes"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.conversations(df).collect()}
    assert {k: r["parent_turn"] for k, r in got.items() if r["parent_turn"] is not None} == {
        (1, 1): 0, (1, 2): 1, (1, 3): 2, (1, 5): 3, (3, 1): 0}
    assert got[1, 5]["reply_path"] == [0, 1, 2, 3, 5] and got[None, 3]["reply_path"] == []
    assert got[1, 1]["body"] == "Fine\nthx" and got[1, 1]["max_level"] == 2
    assert got[2, 0]["body"] == "" and got[None, 3]["body"] == "b"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert quotes.conversations(empty).count() == 0


# 6. Language model --------------------------------------------------------------------------------

def plain_ctw(streams):
    """log10 probability of a stream: every bit by the ratio of the root's weighted probabilities."""
    depth, seen, children = ctw.DEPTH, defaultdict(lambda: [0, 0]), defaultdict(set)

    def decisions(s):
        s = b"\n" * depth + s
        for i in range(depth, len(s)):
            for k in range(8):
                yield (k, s[i] >> (8 - k)), s[i - depth:i], s[i] >> (7 - k) & 1

    for s in streams:
        for node, context, bit in decisions(s):
            for d in range(depth + 1):
                seen[node, context[depth - d:]][bit] += 1
                if d:
                    children[node, context[depth - d + 1:]].add((node, context[depth - d:]))

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def half(x, y):
        return float(np.logaddexp(math.log(.5) + x, math.log(.5) + y))

    memo = {}

    def weighted(k):
        if k not in memo:
            own = kt(*seen.get(k, (0, 0)))
            memo[k] = own if len(k[1]) == depth else half(
                own, sum(map(weighted, children.get(k, ()))))
        return memo[k]

    def after(node, context, bit, d=0):
        """Weighted probability at depth d once `bit` has followed `context` one time more."""
        k = node, context[depth - d:]
        a, b = seen.get(k, (0, 0))
        own = kt(a + (bit == 0), b + bit)
        if d == depth:
            return own
        low = node, context[depth - d - 1:]
        others = sum(weighted(c) for c in children.get(k, ()) if c != low)
        return half(own, others + after(node, context, bit, d + 1))

    @functools.cache
    def ratio(node, context, bit):
        return (after(node, context, bit) - weighted((node, b""))) / math.log(10)

    return lambda s: sum(itertools.starmap(ratio, decisions(s)))


@pytest.mark.parametrize("block, lot", [(ctw.BLOCK_BYTES, ctw.LOT_BYTES), (700, 20)])
def test_tree_weighting_equals_brute_force(spark, monkeypatch, block, lot):
    monkeypatch.setattr(ctw, "BLOCK_BYTES", block)
    monkeypatch.setattr(ctw, "LOT_BYTES", lot)
    rows = [*corpus(25), (7, None), (8, ""), (9, "zzz new " * 300), (9, "zzz new " * 300), (None, "a"),
            (30_002, "\u00e9\u6f22 Unseen\tTHE\x0bof"), (30_003, " \n "), (30_004, "of THE")]
    texts = [(t or "").encode() for _, t in rows]
    streams = [b" ".join(t.lower().split()) + b"\n" for t in texts]
    out = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    assert any(out)
    tokens = [t.lower().split() + [b""] for t in texts]
    counts = Counter(w for ws, o in zip(tokens, out) if not o for w in ws)
    n, v = sum(counts.values()), len(counts)
    log = plain_ctw([s for s, o in zip(streams, out) if not o])
    want = {(d, o, len(ws), sum(counts[w] > 0 for w in ws), n): (
        sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), log(s))
        for (d, _), ws, s, o in zip(rows, tokens, streams, out)}
    got = ctw.scores(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        base, score = want[r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]]
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert math.isclose(r["score"], score, rel_tol=1e-7)


def test_word_order_changes_a_score(spark):
    rows = [(i, "a b c d e f " * 5) for i in range(30)] + [(100, "f c a e d b"), (101, "a b c d e f")]
    got = {r["doc_id"]: r["score"] for r in ctw.scores(frame(spark, rows)).collect()}
    assert got[101] > got[100] + 1


def test_a_block_that_the_scan_cuts_gives_the_same_values(spark):
    rows = [(k % 2, d, t) for k, (d, t) in enumerate(corpus(12))]
    schema = "block long, id long, text string"
    cut = spark.createDataFrame(rows, schema).coalesce(1)  # blocks 0 and 1 in turn: a run per row
    whole = spark.createDataFrame(sorted(rows, key=lambda r: r[0]), schema).coalesce(1)
    assert ctw.index_contexts(cut, 5).count() > ctw.index_contexts(whole, 5).count()
    got, want = (rows_of(ctw.tree_scores(ctw.index_contexts(b, 5), 5, 2)) for b in (cut, whole))
    assert got == want


def test_scores_without_training_and_beside_other_columns(spark):
    alone = [(i, "abc") for i in range(200) if ctw.held_out(i)][:3]
    got = ctw.scores(frame(spark, alone)).collect()
    assert len(got) == 3 and all(
        math.isclose(r["score"], 32 * math.log10(.5), rel_tol=1e-7) and r["train_tokens"] == 0 for r in got)
    schema = "doc_id long, text string, block int, keys string, lot long, n long, word string, c long"
    clash = spark.createDataFrame([(*r, 1, "k", 2, 3, "w", None) for r in TEXTS], schema)
    assert rows_of(ctw.scores(clash)) == rows_of(ctw.scores(frame(spark)))


def test_scores_of_no_documents(spark):
    assert ctw.scores(frame(spark, [])).count() == 0


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 1e6 + 0.5, 3e11])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-11)


# 7. SimHash ---------------------------------------------------------------------------------------

def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_groups_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [*TEXTS, (30, None)]
    for i in range(40):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randint(100, 300))]
        for k in range(rng.choice((1, 1, 3))):
            rows.append((100 + 10 * i + k, " ".join(w)))
            w[rng.randrange(len(w))] = "changed"
    fps = [plain_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    changed = True
    while changed:
        new = [min(group[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= 4)
               for i in range(len(rows))]
        changed, group = new != group, new
    least = {}
    for (d, _), g in zip(rows, group):
        least[g] = min((x for x in (least.get(g), d) if x is not None), default=None)
    want = sorted(((d, f, least[g]) for (d, _), f, g in zip(rows, fps, group)), key=repr)
    for strip in (simhash.STRIP, 3):  # 3: every population count is dealt over several strips
        got = [(i, f % 2 ** 64, c) for i, f, c in simhash.groups(frame(spark, rows),
                                                                 strip=strip).collect()]
        assert sorted(got, key=repr) == want
    kept = [r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()]
    assert sorted(kept, key=repr) == sorted(
        [*{c for _, _, c in want if c is not None}, None], key=repr)


def test_tiles_lose_no_pair():
    rng = np.random.default_rng(1)
    centre = rng.integers(0, 2 ** 63, 40).astype(np.uint64)
    codes = np.concatenate([centre ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 2, False)))
                            for _ in range(20)] + [centre])
    near = np.bitwise_count(codes[:, None] ^ codes[None]) <= 4
    label = np.arange(len(codes))
    while ((new := np.array([label[r].min() for r in near])) != label).any():
        label = new
    assert (simhash.linked(codes, None, 4) == label).all()
    assert len(simhash.linked(codes[:300], codes[300:], 4)) == len(codes)


def test_keep_one_with_clashing_columns(spark):
    schema = "doc_id long, text string, _id int, _again string, _kept_id0 int, component int, id int"
    rows = [(3, LONG, 1, "a", 2, 3, 4), (2, LONG, 1, "b", 2, 3, 4), (2, LONG, 1, "b", 2, 3, 4),
            (None, LONG, 1, "c", 2, 3, 4), (9, None, 1, "d", 2, 3, 4)]
    kept = simhash.keep_one(frame(spark, rows, schema))
    assert kept.columns == ["doc_id", "text", "_id", "_again", "_kept_id0", "component", "id"]
    assert rows_of(kept, "doc_id", "_again") == rows_of(
        frame(spark, [(2, "b"), (None, "c"), (9, "d")], "doc_id long, _again string"))
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_simhash_of_no_documents(spark):
    assert simhash.groups(frame(spark, [])).count() == 0


# 8. Syncmers --------------------------------------------------------------------------------------

def plain_mix(x):
    m = (1 << 64) - 1
    x = x * 0x9E3779B97F4A7C15 & m
    x ^= x >> 29
    x = x * 0xC2B2AE3D27D4EB4F & m
    return x ^ x >> 32


def plain_anchors(text):
    """(position, hash) of every closed syncmer, number by number."""
    gram = [int.from_bytes(text[i:i + 8], "little") for i in range(len(text) - 7)]
    s = [plain_mix(g) for g in gram]
    out = []
    for i in range(len(text) - 31):
        if min(s[i:i + 25]) in (s[i], s[i + 24]):
            h = 0
            for k in (0, 8, 16, 24):
                h = plain_mix(h ^ gram[i + k])
            out.append((i, h >> 16))
    if out or not text:
        return out
    return [(0, int.from_bytes(hashlib.sha256(text).digest()[:8], "little") >> 16)]


def plain_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    x, y = {}, {}
    for d, found in ((x, a), (y, b)):
        for p, h in found:
            d.setdefault(h, p)
    both = sorted((x[h], y[h]) for h in x if h in y)
    best = []
    for i, (_, p) in enumerate(both):
        best.append(1 + max((best[j] for j in range(i) if both[j][1] < p), default=0))
    return max(best, default=0) / len(x.keys() | y.keys())


def test_anchors_are_closed_syncmers():
    text = b"The anchors of a text do not depend on what stands far from them. " * 3
    at, h = syncmers.anchors(text)
    assert list(zip(at.tolist(), (h >> np.uint64(16)).tolist())) == plain_anchors(text)
    later, _ = syncmers.anchors(b"something else: " + text)
    assert {i + 16 for i in at.tolist()} <= set(later.tolist())
    # no cap: anchors grow with the text, and every window of k-mers has one
    words = LONG.encode()
    at, _ = syncmers.anchors(words)
    assert len(at) > len(words) / 30 and np.diff(at).max() <= 25
    f = syncmers.sketch(words)
    again = syncmers.of_text(f.hex())
    assert (again.at == f.at).all() and (again.hashes == f.hashes).all()


def test_edited_texts(spark):
    rows = [(d, t) for d, t in TEXTS if d != 8] + corpus(40)
    rows = [(d, t) for d, t in dict(rows).items()] + [(5000, LONG + "!"), (5001, LONG + "!")]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0]))
    for size in (1000, 7):
        got = {r["doc_id"]: r for r in syncmers.edited(frame(spark, rows), rows_in_range=size)
               .collect()}
        assert len(got) == len(rows)
        for (d, t), (_, u) in zip(order, order[1:] + order[:1]):
            t, u = t or "", u or ""
            q = len(t) // 4
            new = t[:len(t) - q] + u[:q]
            r = got[d]
            assert r["n_chars"] == len(t)
            assert r["edited_sha256"] == hashlib.sha256(new.encode()).hexdigest()
            if len(t) + len(u) > 20_000:
                continue
            f, g, h = (plain_anchors(x.encode()) for x in (t, new, u))
            ends = [0, *(p for p, _ in f)]
            assert r["fingerprint"] == "".join(
                f"{v:012x}{p - q:02x}" for q, (p, v) in zip(ends, f))
            assert r["near_edited"] == plain_likeness(f, g)
            assert r["near_next"] == plain_likeness(f, h)
    assert got[5000]["near_next"] == 1.0 and 0.95 < got[5000]["near_edited"] < 1.0


def test_likeness_of_an_edit():
    rng = random.Random(8)
    a, b = (" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(500)) for _ in range(2))
    q = len(a) // 4
    f, g = syncmers.sketch(a.encode()), syncmers.sketch((a[:len(a) - q] + b[:q]).encode())
    assert 0.5 < syncmers.likeness(f, g) < 0.65  # 3/4 of one text, shared by 5/4
    assert syncmers.likeness(f, syncmers.sketch(b.encode())) < 0.1


def test_edited_of_one_and_no_text(spark):
    one = syncmers.edited(frame(spark, [(4, "abcdefgh")])).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert syncmers.edited(frame(spark, [])).count() == 0
    repeated = syncmers.edited(frame(spark, [(8, "abcd"), (8, "abcd"), (9, "wxyz")])).collect()
    assert len(repeated) == 3


# 9. Packing ---------------------------------------------------------------------------------------

def plain_ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    return [(d, t.encode(x or "", add_special_tokens=False).ids + [1]) for d, x in TEXTS]


def test_packing_keeps_every_token_once(spark):
    for df in (frame(spark).repartition(3), extra(spark)):
        cut = packing.pieces(df, WORDS, length=64)
        got = cut.collect()
        by_sequence = defaultdict(list)
        for r in got:
            by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        for k, parts in by_sequence.items():
            parts.sort()
            assert [a for a, _ in parts] == [sum(n for _, n in parts[:i])
                                             for i in range(len(parts))]
            assert sum(n for _, n in parts) == 64 or k == max(by_sequence)
        pieces = Counter((r["doc_id"], r["start"], bytes(r["ids"])) for r in got)
        for d, ids in plain_ids():
            starts = {s for (x, s, b), n in pieces.items() if x == d
                      and np.frombuffer(b, "<u4").tolist() == ids[s:s + len(b) // 4]}
            assert 0 in starts
        assert sum(r["length"] for r in got) == sum(len(i) for _, i in plain_ids())
        assert sum(r["doc_tokens"] for r in got if r["start"] == 0) == sum(
            len(i) for _, i in plain_ids())
        full = packing.sequences(cut, length=64).collect()
        assert all(len(r["ids"]) == 64 for r in full if r["sequence_id"] != max(by_sequence))
    digest = packing.digests(cut).filter("doc_id = 1 AND start = 0").first()
    ids = dict(plain_ids())[1][:digest["length"]]
    assert digest["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing_pads_unless_a_power_of_two(spark):
    assert packing.padded_length(16) == 16 and packing.padded_length(17) == 2048
    assert packing.pieces(frame(spark, []), WORDS).count() == 0


def test_memory_of_words_starts_anew(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 20)
    monkeypatch.setattr(packing, "CACHE_PARTS", 9)
    t = packing.WordTokens(WORDS, False)
    texts = [" ".join(f"a{i}b, it's c{i}" for i in range(k, k + 9)).encode() for k in range(30)]
    for k, text in enumerate(texts):
        ids = np.frombuffer(t.packed(pa.array([text], pa.binary()))[0], t.code).tolist()
        assert ids == t.tokenizer.encode(text.decode(), add_special_tokens=False).ids


def test_memory_of_words_by_caller():
    t = packing.word_tokens(WORDS, True, 30, 9)
    for k in range(30):
        text = " ".join(f"a{i}b, it's c{i}" for i in range(k, k + 9)).encode()
        ids = np.frombuffer(t.packed(pa.array([text], pa.binary()))[0], t.code).tolist()
        assert ids == t.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        assert len(t.known.number) <= 30
    assert token_files.CACHE_WORDS < packing.CACHE_WORDS


# 10. Token files ----------------------------------------------------------------------------------

def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    want = sorted(len(t.encode(x or "", add_special_tokens=False).ids) for _, x in TEXTS)
    path = new_path(spark, "flat")
    token_files.write(extra(spark).coalesce(2), path, WORDS, file_bytes=60)
    for block in (1 << 20, 7, 1):
        got = token_files.counts(spark, f"{path}/kind=tokens", block_tokens=block).collect()
        assert sorted(r["n_tokens"] for r in got) == want and all(r["ended"] for r in got)
        assert len({r["file"] for r in got}) > 2
    each = token_files.of_documents(extra(spark), WORDS)
    assert rows_of(each, "doc_id", "n_tokens") == sorted(
        ((i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in TEXTS), key=repr)
    assert token_files.of_documents(frame(spark, []), WORDS).count() == 0
    with pytest.raises(ValueError):
        token_files.write(extra(spark), path + "-narrow", WORDS, width=1)


def test_open_and_empty_documents(spark, tmp_path):
    ids = [5, 6, 0, 0, 7, 0, 8, 9]
    (tmp_path / "part-a").write_bytes(np.array(ids, "<u2").tobytes())
    (tmp_path / "part-b").write_bytes(b"")
    (tmp_path / "part-c").write_bytes(np.array([0], "<u2").tobytes())
    for block in (3, 100):
        got = token_files.counts(spark, str(tmp_path), block_tokens=block).collect()
        a = sorted(tuple(r)[1:] for r in got if r["file"].endswith("part-a"))
        assert a == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 1, True), (3, 6, 2, False)]
        assert [tuple(r)[1:] for r in got if r["file"].endswith("part-c")] == [(0, 0, 0, True)]


def test_broken_token_file(spark, tmp_path):
    (tmp_path / "part-a").write_bytes(b"abc")
    with pytest.raises(Exception, match="broken token file"):
        token_files.counts(spark, str(tmp_path)).collect()


# SQL twins and the pipeline -----------------------------------------------------------------------

def tables(folder, documents, conversations=()):
    d = [tuple(r) for r in documents]
    pq.write_table(pa.table({
        "doc_id": pa.array([r[0] for r in d], pa.int64()),
        "text": pa.array([r[1] for r in d], pa.string()),
        "lang": pa.array(["en"] * len(d)), "source": pa.array(["s"] * len(d)),
        "n_chars": pa.array([len(r[1] or "") for r in d], pa.int64())}),
        folder / "documents.parquet")
    pq.write_table(pa.table({
        "doc_id": pa.array([r[0] for r in d], pa.int64()),
        "quality": pa.array([1] * len(d), pa.int32()),
        "toxic": pa.array([int("scum" in (r[1] or "")) for r in d], pa.int32())}),
        folder / "labels.parquet")
    return str(folder)


def test_pipeline_equals_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    docs = []
    for i in range(60):
        w = [f"word{rng.randrange(400)}" for _ in range(120)]
        if i % 5 == 0:
            w[::8] = ["scum"] * len(w[::8])
        docs.append((i, " ".join(w)))
    docs += [(100 + i, docs[1][1]) for i in range(5)] + [(200, None), (201, ""), (202, "short")]
    folder = tables(tmp_path, docs)
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()}
    assert got == {i for i in range(60) if i % 5}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "quality", "near_duplicates", "packing"]
    start = spark.read.parquet(f"{folder}/documents.parquet")
    for _, step in corpus_pipeline.STAGES[:-1]:
        start = step(spark, start, folder)
        assert start.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_sql_of_quality_and_chat(spark, tmp_path):
    import duckdb

    folder = tables(tmp_path, [*((d, t) for d, t in TEXTS if d not in (8, None)), *corpus(30)][:36])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    docs = spark.read.parquet(f"{folder}/documents.parquet").dropDuplicates(["doc_id"])
    con.execute("CREATE TABLE d AS SELECT DISTINCT ON (doc_id) * FROM documents")
    got = quality.judge(docs).toPandas().sort_values("doc_id").to_numpy().tolist()
    assert len(got) == con.execute("SELECT count(*) FROM d").fetchone()[0]
