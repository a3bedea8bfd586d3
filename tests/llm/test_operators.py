"""The training-data operators against brute force, and on odd input."""

import hashlib
import itertools
import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from codexlake.llm import chat_format, decontaminate, html_extract, language_id, near_dedup, quality_rules, queries, secret_scan, shared, simhash_dedup, source_mix, token_output, url_filter

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, fingerprint string, kept boolean, row string, `key` string, hash string"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang[, source]]), with extra columns whose names operators might use."""
    full = [(*r, *("en", "s")[len(r) - 2 :]) for r in rows]
    return spark.createDataFrame([(*r, 0, "f", True, "r", "k", "h") for r in full], DOC)


def odd(spark):
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    texts = [None, "", "  \n\t ", "one", "one two", "a b c a b c", long, long, "é ü ß 日本", "a" * 5000]
    return [(i, t) for i, t in enumerate(texts)] + [(3, "one"), (None, "no id"), (None, "no id either")]


def sample(spark, n=200):
    return [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(n).collect()]


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# -- 1


def brute_print(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = tokens(w)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows):
    prints = [brute_print(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [(r[0], f"{p:016x}", least.get(find(i))) for i, (r, p) in enumerate(zip(rows, prints, strict=True))]


def test_simhash_groups_equal_brute_force(spark):
    rows = sample(spark) + [(10_000 + i, t + " more") for i, (_, t, *_) in enumerate(sample(spark, 40))] + odd(spark)[:6]
    got = [tuple(r) for r in simhash_dedup.simhash_groups(docs(spark, rows)).collect()]
    assert Counter(got) == Counter(brute_groups(rows))


def test_links_are_all_within_two_bits(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = {x for b in base for x in [b] + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(12)]}
    sign = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in sign], "fingerprint long")
    got = {(r.u, r.v) for r in simhash_dedup.links(df).collect()}
    want = {(min(a, b), max(a, b)) for a in sign for b in sign if a != b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert got == want and want


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    got = simhash_dedup.components(edges).collect()
    assert {r.root for r in got} == {0} and len(got) == 300


def test_one_of_each_group_keeps_columns(spark):
    rows = odd(spark)
    got = simhash_dedup.one_of_each_group(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    ids = [r.doc_id for r in got.collect()]
    assert ids.count(6) == 1 and 7 not in ids and ids.count(3) == 1  # copies and a repeated row go
    assert 0 in ids and 1 not in ids and ids.count(None) == 2


def brute_near(rows):
    """Ids kept, one of each group of texts whose sets of five-word shingles are 0.8 similar."""
    sets = []
    for _, t in rows:
        w = tokens((t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    return sorted({find(i): min(rows[j][0] for j in range(len(rows)) if find(j) == find(i)) for i in range(len(rows))}.values())


def near_rows():
    """Changed words at every distance around 0.8, one large group of near-copies, a passage in most texts."""
    rng = random.Random(7)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, texts = make(30), []
    for i in range(12):
        base = make(60 + 10 * i)
        texts += [base] + [[f"x{k}" if k % (20 * j) == 7 else w for k, w in enumerate(base)] for j in range(1, 6)] + [base[: len(base) * 4 // 5 + 1], base + make(12)]
    core = make(100)
    texts += [[*core[:at], f"y{at}", *core[at + 1 :]] for at in range(80)]
    texts += [make(40) + passage + make(40) for _ in range(60)] + [passage + make(k) for k in range(8)]
    rows = [" ".join(t) for t in texts]
    return [(i, t) for i, t in enumerate([*rows, rows[3], rows[3].upper(), None, "", " ", "one two", "One  two", "a b c d e"])]


@pytest.mark.parametrize("few", [4, near_dedup.FEW])
def test_near_duplicates_equal_brute_force_jaccard(spark, few, monkeypatch):
    monkeypatch.setattr(near_dedup.similar_groups, "__defaults__", (few,))
    rows = near_rows()
    table = docs(spark, rows)
    got = near_dedup.one_of_each_group(table)
    assert got.columns == table.columns
    assert sorted(r.doc_id for r in got.collect()) == brute_near(rows)


def test_pipeline_drops_texts_that_are_similar_at_0_8(spark):
    import corpus_pipeline

    rows = near_rows()[:8]
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs(spark, rows), SF).collect()) == brute_near(rows)


def test_near_duplicates_meet_by_fingerprints_first(spark, monkeypatch):
    import corpus_pipeline

    rng = random.Random(4)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(400)] for _ in range(6)]
    rows = [(10 * i + k, " ".join(w + [f"end{k}"] * (k > 0))) for i, w in enumerate(base) for k in range(3)]
    sets = [near_dedup.shingle_set(t) for _, t in rows]
    for s in sets:
        h = [int(x) & (2**64 - 1) for x in s]
        assert near_dedup.fingerprint(s) & (2**64 - 1) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    prints = {d: near_dedup.fingerprint(s) for (d, _), s in zip(rows, sets, strict=True)}
    near = {(a, b) for a, b in itertools.combinations(prints, 2) if bin((prints[a] ^ prints[b]) & (2**64 - 1)).count("1") <= 2}
    assert len(near) >= 6 and all(a // 10 == b // 10 for a, b in near)
    table = shared.stored(spark.createDataFrame(list(prints.items()), "node long, fingerprint long"), "prints-test")
    pairs = {(r.u, r.v) for r in near_dedup.print_pairs(table).collect()}
    assert pairs <= near and {d for p in pairs for d in p} == {d for p in near for d in p}
    # the stage begins with them, and one text of each group stays
    met, ask = [], near_dedup.print_pairs
    monkeypatch.setattr(near_dedup, "print_pairs", lambda t: met.append(ask(t)) or met[-1])
    got = corpus_pipeline.drop_copies(spark, docs(spark, rows), SF)
    assert len(met) == 1 and sorted(r.doc_id for r in got.collect()) == brute_near(rows) == [0, 10, 20, 30, 40, 50]


def test_near_duplicates_take_little_disk(spark, monkeypatch):
    """Keys of one text are not passed on, and what a step has stored goes before the next ones."""
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2000))) for i in range(150)]
    rows += [(1000 + i, f"{t} more") for i, t in rows[:20]]
    n_keys = sum(len(s := near_dedup.shingle_set(t)) - near_dedup._least_shared(len(s)) + 1 for _, t in rows)
    made, ask, left = [], near_dedup.stored, {}

    def stored(df, name, *args, **named):
        left[name] = {n for n, f in made if os.path.exists(f)}
        made.append((name, (out := ask(df, name, *args, **named)).inputFiles()[0].removeprefix("file://")))
        return out

    monkeypatch.setattr(near_dedup, "stored", stored)
    table = shared.stored(docs(spark, rows), "disk-test")
    store = spark.sparkContext._jsc.sc().statusStore()
    written = lambda: sum(e.totalShuffleWrite() for e in spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.executorList(True)))
    before = written()
    got = sorted(r.doc_id for r in near_dedup.one_of_each_group(table).collect())
    assert got == [i for i, _ in rows[:150]]
    assert not {"pair-sets", "prefixes"} & left["pairs"] and "texts" in left["pairs"]
    # two packed passes of four bytes a key, and the keys that two texts have; in rows each of the passes took more than that
    assert written() - before < 24 * n_keys, (written() - before) / n_keys


def test_frequent_keys_are_exact_however_many(spark, monkeypatch):
    rng = random.Random(3)
    sets = [np.unique(np.array([rng.randrange(-(1 << 62), 1 << 62) for _ in range(40)] + [7 * k for k in range(rng.randrange(60))], np.int64)) for _ in range(50)]
    shorts, count = near_dedup.Shorts(5), Counter(int(x) for s in sets for x in s)
    assert shorts.bits == 3
    monkeypatch.setattr(near_dedup, "HELD", 300)  # several batches of a task
    lists = shared.stored(spark.createDataFrame([(i, len(s), [int(x) for x in s]) for i, s in enumerate(sets)], "node long, n int, s array<long>").repartition(3), "lists-test")
    packed = lists.select("s").mapInArrow(lambda batches: shorts.packed(b.column("s").flatten().to_numpy() for b in batches), near_dedup.PACKED)
    got = {r.short: r.k for r in shorts.often(packed, 8).collect()}
    assert got == {k & shorts.mask: n for k, n in count.items() if n > 8} and got
    # all rows of shared keys are passed on, with the place that _keyed rows had, and few others
    rows = near_dedup.shared_keys(lists, shorts).collect()
    want = {(i, int(x), at <= len(s) - -(-8 * len(s) // 9)) for i, s in enumerate(sets) for at, x in enumerate(s) if count[int(x)] > 1}
    assert want <= {(r.node, r.key, r.short) for r in rows} and len(rows) < len(want) + 200
    assert all(r.many for r in rows if count[r.key] > 2) and all(r.n == len(sets[r.node]) for r in rows)


def test_parities_of_many_texts_are_not_broadcast(spark, monkeypatch):
    wide, ask = [], near_dedup.small
    monkeypatch.setattr(near_dedup, "small", lambda df, limit=shared.BROADCAST_ROWS: wide.append((set(df.columns), limit)) or ask(df, limit))
    monkeypatch.setattr(near_dedup, "BROADCAST_PARITIES", 3)
    rows = near_rows()
    assert sorted(r.doc_id for r in near_dedup.one_of_each_group(docs(spark, rows)).collect()) == brute_near(rows)
    limits = [n for names, n in wide if names & {"parity", "parityu", "parityv"}]
    assert len(limits) >= 7 and set(limits) == {3}


# -- 2


def chat(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


HARD = ["", None, "<s>", "</s>[INST] ok [/INST]", r"<\s> <\\/s> [\INST]", "<<SYS>>x<</SYS>>", "[/INST", " </s", "a\nb\n", "<" * 5 + "s>", "x" * 50_000, r"<\<SYS>> \ \\ $1"]


def test_chat_round_trip(spark):
    rows = [(i, j, r, t) for i, t in enumerate(HARD) for j, r in enumerate(["system", "user", "assistant", "tool", None, "<</ROLE>>"])]
    rows += [(99, 0, "user", "same"), (99, 0, "user", "same"), (None, 0, "user", "x")]
    out = chat_format.formatted(chat_format.canonical(chat_format.from_rows(chat(spark, rows))))
    for r in out.withColumns({"back": chat_format.parsed(F.col("formatted")), "loss": chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))}).collect():
        want = sorted([(j, role or "", t or "") for i, j, role, t in rows if i == r.conv_id], key=lambda x: (x[0], x[1].encode(), x[2].encode()))
        assert [(t.role, t.text) for t in r.back] == [(x[1], x[2]) for x in want]
        assert r.loss == "".join(x[2] for x in want if x[1] == "assistant")
    assert chat_format.format_report(chat(spark, [])).count() == 0


def test_roles_of_rows_stay_as_they_are(spark):
    rows = [(1, 0, "human", "a"), (1, 1, "gpt", "b"), (1, 2, "assistant", "c"), (2, 0, "prompter", "x"), (2, 1, "bot", None), (2, 2, "model", "")]
    got = {r.conv_id: (r.turns_sha256, r.loss_chars) for r in chat_format.format_report(chat(spark, rows)).collect()}
    sha = lambda *turns: hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    assert got == {1: (sha(("human", "a"), ("gpt", "b"), ("assistant", "c")), 1), 2: (sha(("prompter", "x"), ("bot", ""), ("model", "")), 0)}


def test_chat_layouts(spark):
    cases = {
        '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}': ("messages role content", [("user", "a"), ("assistant", "b")]),
        '[{"role":"user","content":"a"}]': ("list role content", [("user", "a")]),
        '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}': ("conversations from value", [("user", "a"), ("assistant", "")]),
        '{"instruction":"do","input":"x","output":"y"}': ("instruction input output", [("user", "do\nx"), ("assistant", "y")]),
        '{"instruction":"do","input":"","output":"y"}': ("instruction input output", [("user", "do"), ("assistant", "y")]),
        '{"system":"s","prompt":"p","response":"r"}': ("prompt response", [("system", "s"), ("user", "p"), ("assistant", "r")]),
        '{"question":"q","answer":"a"}': ("question answer", [("user", "q"), ("assistant", "a")]),
        '{"messages":[]}': ("messages role text", []),
        '{"unknown":1.25}': (None, None),
        "null": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "j string").withColumn("record", F.parse_json("j"))
    for r in chat_format.formatted(chat_format.canonical(df)).collect():
        layout, turns = cases[r.j]
        assert (r.layout, None if r.turns is None else [(t.role, t.text) for t in r.turns]) == (layout, turns)
        assert (r.formatted is None) == (layout is None)


# -- 3


def test_url_rules_and_collisions(spark):
    urls = ["http://a.example.com/en/7", "https://EXAMPLE.com/en/8", "x://com/en/", "http://notcom/en/", "ftp://b.net/de/1?x", "http://example.net/de/8", "http://c.net/fr", "http://ads-track.example.org/fr#y", None, "no scheme", "http://", "http://spam-farm.example.com.evil/x"]
    index = url_filter.build_index(queries.RULES, queries.BLOCKED_HOSTS)
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(urls)] + [(0, urls[0], "h", "v")], "page_id long, url string, host string, verdict string")
    got = {r.page_id: (r.url_filter.rule, r.url_filter.verdict) for r in url_filter.filtered(pages, queries.RULES, queries.BLOCKED_HOSTS).collect()}
    assert got == {0: ("example.com/en/7", "allow"), 1: ("com/en/", "block"), 2: ("com/en/", "block"), 3: (None, "allow"), 4: ("net/de/", "allow"), 5: ("example.net/de/8", "block"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "allow"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow")}
    assert url_filter.filtered(pages.limit(0), queries.RULES, queries.BLOCKED_HOSTS).count() == 0
    assert url_filter.filtered(pages, [], []).filter("url_filter.verdict = 'block'").count() == 0
    assert index[:8] == b"URLIDX01"


def test_equal_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s: len(s))
    path = tmp_path / "i"
    path.write_bytes(url_filter.build_index([url_filter.Rule("block", "aa", "/x"), url_filter.Rule("allow", "bb", "/x")], ["cc.d"]))
    assert url_filter.DigestArray(str(path)).find([b"aa/x", b"bb/x", b"zz/x", b"cc.d"]) == [url_filter.BLOCK, url_filter.ALLOW, None, url_filter.HOST]


# -- 4


def brute_measures(text):
    w, text = tokens(text), text or ""
    win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(win)
    covered = {i + k for i, x in enumerate(win) if n[x] > 1 for k in range(3)}
    ls = [x for x in text.split("\n") if tokens(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(ls) - len(set(ls)), len(covered)


def test_base_measures_equal_brute_force(spark):
    rows = sample(spark) + odd(spark) + [(500, "a b a b a b a b"), (501, "x\ny\nx\n \n \nx"), (502, "#*$ %&|<> #")]
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.quality_report(docs(spark, rows)).collect())
    assert got == Counter((r[0], *brute_measures(r[1])) for r in rows)


def brute_kept(rows):
    """Ids of documents within the fences of their language and source, with their share of the larger groups' values."""
    bucket = lambda x: x >> max(0, x.bit_length() - 7) << max(0, x.bit_length() - 7)
    rates = {}
    for r in rows:
        n, chars, symbols, dup, repeat = brute_measures(r[1])
        n_lines = len([x for x in (r[1] or "").split("\n") if tokens(x)])
        if n >= 50 and 100 * repeat <= 50 * n:
            sure = lambda k: max(k - 2 * math.sqrt(k), 0)
            rates[r[0]] = (r[2], r[3], (1000 * symbols // n, 100 * chars // n, 1000 * dup // max(1, n_lines)), (1000 * sure(symbols) / n, 100 * chars // n, 1000 * sure(dup) / max(1, n_lines)))
    kept, fences = set(), {}
    for d, (lang, source, _, have) in rates.items():
        ok = True
        for m in range(3):
            if (lang, source, m) not in fences:
                whole, of_lang, own = (Counter(bucket(x[2][m]) for x in rates.values() if f(x)) for f in (lambda x: True, lambda x: x[0] == lang, lambda x: x[:2] == (lang, source)))  # noqa: B023
                blend = {b: 1000 * own[b] + 100_000 * of_lang[b] // sum(of_lang.values()) + 10_000 * whole[b] // sum(whole.values()) for b in sorted(whole)}
                upto = list(itertools.accumulate(blend.values()))
                q1, q3 = (next(b for b, n in zip(blend, upto, strict=True) if 4 * n >= k * upto[-1]) for k in (1, 3))
                reach = 3 * (q3 - q1 + (1 << max(0, q3.bit_length() - 7)))
                fences[lang, source, m] = q1 - reach, q3 + reach
            low, high = fences[lang, source, m]
            ok &= have[m] <= high and (m != 1 or have[m] >= low)
        if ok:
            kept.add(d)
    return kept


def test_small_groups_lean_on_their_language(spark):
    """Four documents of a source with marks everywhere are not enough for fences of their own; four hundred are."""
    rng = random.Random(9)
    plain = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(3, 7) + str(rng.randrange(999)) for _ in range(80))
    marked = lambda: plain().replace(" ", " # ", 40)
    calm = [(i, plain(), "en", "calm") for i in range(400)]
    kept = lambda rows: {r.doc_id for r in quality_rules.keep_good(docs(spark, rows)).collect()}
    few = [(1000 + i, marked(), "en", "few") for i in range(4)]
    many = [(2000 + i, marked(), "en", "many") for i in range(400)]
    got = kept(calm + few)
    assert not {r[0] for r in few} & got and {r[0] for r in calm} <= got
    assert {r[0] for r in calm + many} <= kept(calm + many)
    # one, two or four symbols in a short text say nothing, a dozen do
    some = [(3000 + k, plain().replace(" ", " # ", k), "en", "calm") for k in (1, 2, 4, 12, 30)]
    assert {d for d in kept(calm + some) if d >= 3000} == {3001, 3002, 3004}


def test_fences_decide_and_differ_by_group(spark):
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    report = {r.doc_id: r for r in quality_rules.quality_report(table).collect()}
    assert {d for d, r in report.items() if r.kept} == brute_kept(rows)
    limits = quality_rules.thresholds(quality_rules.sketches(shared.stored(quality_rules.measure(table), "measured"))).collect()
    assert len({(r.word_length_low, r.word_length_high) for r in limits}) > 1
    # no one cutoff gives such verdicts: a length that is far out in one source is common in another
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(n + rng.randint(-1, 1))) for _ in range(80))
    short, long = [(i, text(5), "en", "short") for i in range(150)], [(1000 + i, text(9), "en", "long") for i in range(150)]
    report = {r.doc_id: r.kept for r in quality_rules.quality_report(docs(spark, [*short, *long, (5000, text(9), "en", "short"), (5001, text(5), "en", "long")])).collect()}
    assert not report[5000] and not report[5001] and sum(report.values()) >= 295


def test_thresholds_follow_their_group(spark):
    rng = random.Random(5)
    plain = lambda: " ".join(rng.choice("abcdefgh") * rng.randint(3, 7) + str(rng.randrange(999)) for _ in range(80))
    calm = [(i, plain(), "en", "calm") for i in range(300)]
    marked = [(1000 + i, plain().replace(" ", " # ", 40), "en", "marked") for i in range(300)]
    bad = [(5000, plain().replace(" ", " ### "), "en", "calm"), (5001, plain().replace(" ", " # ", 40), "en", "calm"), (5002, plain(), None, None)]
    kept = {r.doc_id for r in quality_rules.keep_good(docs(spark, calm + marked + bad)).collect()}
    assert {r[0] for r in calm + marked} <= kept and not {5000, 5001} & kept and 5002 in kept


def test_keep_good_on_odd_input(spark):
    assert quality_rules.keep_good(docs(spark, odd(spark))).columns == docs(spark, odd(spark)).columns
    assert quality_rules.keep_good(docs(spark, odd(spark)).limit(0)).count() == 0
    assert quality_rules.keep_good(docs(spark, [(1, None), (2, "")])).count() == 0


# -- 5


def brute_contaminated(rows, items):
    def sh(t):
        w = tokens((t or "").lower())
        return len(w), [" ".join(w[i : i + 5]) for i in range(len(w) - 4)] if len(w) > 4 else [" ".join(w)] if w else []

    out = {}
    for i, t in items:
        n, want = sh(t)
        for d, text in {(r[0], r[1]) for r in rows}:
            _, have = sh(text)
            k = max(1, n - 4)
            for a in range(max(1, len(have) - k + 1)):
                win = have[a : a + k]
                shared_ = sum((Counter(win) & Counter(want)).values())
                if win and want and 9 * shared_ >= 4 * (len(win) + len(want)):
                    out[d, i] = max(out.get((d, i), 0), round(shared_ / (len(win) + len(want) - shared_), 6))
    return out


def test_contamination_equals_brute_force(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    text = lambda n: " ".join(word() for _ in range(n))
    items = [(i, text(20 + 3 * i)) for i in range(8)] + [(90, ""), (91, None), (92, "a b"), (93, "la " * 30)]
    rows = [(i, text(60)) for i in range(20)]
    for i, t in items[:8]:
        w = t.split()
        rows += [(100 + i, f"{text(30)} {t} {text(9)}"), (200 + i, t.upper()), (300 + i, f"{text(5)} {' '.join(w[1:])}")]
        rows += [(400 + i, f"{text(7)} {' '.join([*w[:3], word(), *w[4:]])} {text(7)}"), (500 + i, f"{text(6)} {' '.join([*w[: len(w) // 2], word(), *w[len(w) // 2 :]])}")]
    rows += [(600, "a b"), (601, "x a b y"), (602, "la " * 29), (603, None), (604, ""), (100, rows[20][1]), (605, text(2000) + " " + items[7][1])]
    got = decontaminate.contamination_report(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 6) for r in got} == brute_contaminated(rows, items)
    clean = decontaminate.clean_documents(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in clean.collect()} == {r[0] for r in rows} - {d for d, _ in brute_contaminated(rows, items)}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean_documents(docs(spark, rows), none).count() == len(rows)


def test_index_prunes_and_keeps(spark):
    """Of random fingerprints few pairs are candidates; pairs within the radius all are."""
    rng = random.Random(8)
    sign = lambda v: [(x - (1 << 64)) if x >> 63 else x for x in (v & ((1 << 64) - 1), v >> 64)]
    items = [rng.getrandbits(128) for _ in range(40)]
    near = [(i, x ^ sum(1 << b for b in rng.sample(range(128), rng.choice([0, 20, 33, 34])))) for i, x in enumerate(items) for _ in range(6)]
    table = spark.createDataFrame([(i, 9, sign(x)) for i, x in enumerate(items)], "item_id long, n_words int, item_print array<long>")
    rows = [((k, 0), 9, 0, sign(x)) for k, (_, x) in enumerate(near)]
    found = spark.createDataFrame(rows, "name struct<doc_id: long, hash: long>, n_words int, start int, print array<long>")
    got = {(r.name.doc_id, r.item_id) for r in decontaminate.candidates(found, table).collect()}
    assert got == {(k, j) for k, (_, x) in enumerate(near) for j, y in enumerate(items) if (x ^ y).bit_count() <= decontaminate.RADIUS}
    keys = lambda c, balls: {tuple(r.k) for r in c.select(decontaminate.segments(F.col("p"), balls).alias("k")).collect()}
    random_ = lambda n: spark.createDataFrame([(sign(rng.getrandbits(128)),) for _ in range(n)], "p array<long>")
    a, b = keys(random_(60), decontaminate.WINDOW_BALLS), keys(random_(60), decontaminate.ITEM_BALLS)
    share = sum(bool(set(x) & set(y)) for x in a for y in b) / (len(a) * len(b))
    print("random pairs that meet in the index:", share)
    assert share < 0.25


def test_long_items_and_empty_tables(spark):
    long = " ".join(f"w{i}" for i in range(17_000))
    items = spark.createDataFrame([(1, long)], "item_id long, text string")
    got = decontaminate.contamination_report(docs(spark, [(1, "a b " + long + " c"), (2, "w1 w2 w3 w4 w5 w6")]), items).collect()
    assert [(r.doc_id, r.item_id, r.start) for r in got] == [(1, 1, 2)]
    assert decontaminate.contamination_report(docs(spark, [(1, "x")]).limit(0), items).count() == 0


# -- 6


def test_files_in_training_order(spark):
    import corpus_pipeline

    mixed = shared.stored(source_mix.mixed_documents(docs(spark, [(i, f"some words {i} here", "en", "ab"[i % 2]) for i in range(300)])), "mixed")
    order = shared.file_order(mixed)
    want = [r.doc_id for r in mixed.select("doc_id", *order).orderBy(*order).collect()]
    got = [r.doc_id for r in corpus_pipeline.write_tokens(spark, mixed, SF).orderBy("start").collect()]
    assert got == want and want != sorted(want)


def test_large_ids_beside_null_ones(spark):
    got = token_output.tokenized(docs(spark, [(2**53 + 1, "a"), (None, "b")]), queries.tokenizer_path()).collect()
    assert {r.doc_id for r in got} == {2**53 + 1, None}


def test_bounded_memory_gives_the_same_ids(spark, monkeypatch):
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        encoder = token_output.PieceEncoder(f.read())
    texts = [r[1] for r in sample(spark) if r[1]]
    whole = encoder.encode(texts)
    monkeypatch.setattr(token_output, "REMEMBERED_BYTES", 20_000)
    encoder.forget()
    assert [encoder.encode([t])[0] for t in texts] == whole and len(encoder.known) < 3000


def test_pipeline_workers_remember_fewer_words(spark, monkeypatch):
    import corpus_pipeline

    asked, make = [], token_output.write_files
    monkeypatch.setattr(token_output, "write_files", lambda *a, **k: asked.append(k["remembered"]) or make(*a, **k))
    rows = docs(spark, sample(spark))
    got = corpus_pipeline.write_tokens(spark, rows, SF).orderBy("start").collect()
    assert got == token_output.tokenized(rows, queries.tokenizer_path()).orderBy("start").collect()
    assert asked == [corpus_pipeline.REMEMBERED_BYTES, None] and 4 * corpus_pipeline.REMEMBERED_BYTES <= token_output.REMEMBERED_BYTES
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        encoder = token_output.PieceEncoder(f.read(), 20_000)
    for r in sample(spark):
        encoder.encode([r[1] or ""])
    assert len(encoder.known) < 3000


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    rows = sample(spark) + odd(spark) + [(800, " lead"), (801, "trail "), (802, "two  spaces"), (803, "a\n\nb"), (804, "a \n b"), (805, "it's <|endoftext|> don't"), (806, "x\u00a0y\u2003z"), (807, "tab\tbed\r\nline")]
    folder = shared.new_path(spark, "tokens-test")
    got = token_output.tokenized(docs(spark, rows), queries.tokenizer_path(), folder).collect()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    ids = [[*tok.encode(t or "", add_special_tokens=False).ids, 0] for _, t, *_ in rows]
    crc = lambda x: zlib.crc32(b"".join(i.to_bytes(4, "little") for i in x))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((r[0], len(x), crc(x)) for r, x in zip(rows, ids, strict=True))
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    first = sorted(r.path for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.tokz").load(folder).select("path").collect())[0]
    assert token_output.read_document(folder, first.rsplit("/", 1)[1], 2) in [x for r, x in zip(rows, ids, strict=True) if r[0] == 0]


def test_any_text_is_encoded_as_the_library_does():
    from tokenizers import Tokenizer

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        encoder = token_output.PieceEncoder(f.read())
    tok, rng = Tokenizer.from_file(queries.tokenizer_path()), random.Random(6)
    bits = ["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\t", "word", "Wort's", "é", "12", "!?", "\u00a0", "x" * 40, "<", "don't"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(1500)]
    assert sum("<|endoftext|>" in t for t in texts) > 300
    got = [ids for a in range(0, len(texts), 100) for ids in encoder.encode(texts[a : a + 100])]
    assert [np.frombuffer(x, encoder.dtype).tolist() for x in got] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_token_files_of_an_empty_table(spark):
    assert token_output.tokenized(docs(spark, [(1, "x")]).limit(0), queries.tokenizer_path()).count() == 0


def test_many_small_files(spark):
    rows = [(i, f"text number {i} " * 50) for i in range(200)]
    folder = shared.new_path(spark, "tokens-test")
    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        files = token_output.write_files(docs(spark, rows).select("doc_id", "text"), folder, f.read(), file_bytes=200)
    assert files.count() > 4 and token_output.read_files(spark, folder, files).count() == 200


def test_next_task_of_a_worker_learns_no_word_again(monkeypatch, tmp_path):
    import pyarrow as pa

    with open(queries.tokenizer_path(), encoding="utf-8") as f:
        tokenizer = f.read()
    learned, learn = [], token_output.PieceEncoder._learn
    monkeypatch.setattr(token_output.PieceEncoder, "_learn", lambda self, pieces: (learned.append(set(pieces)), learn(self, pieces)))
    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "text": ["the words of one text", "of another one"]})
    token_output._encoder.cache_clear()
    files = [token_output.write_part([rows], part, str(tmp_path), tokenizer, b"") for part in range(2)]
    assert len(learned[0]) == 7 and learned[1:] == [set()]
    (tmp_path / f"{token_output.dictionary_hash(b'').hex()}.dictionary").write_bytes(b"")
    a, b = [[token_output.read_document(str(tmp_path), f[0][0], i) for i in range(2)] for f in files]
    assert a == b
    next(token_output._read(iter(())), None)  # what comes after the writing drops the words
    assert token_output._encoder.cache_info().currsize == 0


# -- 7


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/">Menu one two</a></li></ul></nav><header>Site</header>
<div class="ad">Buy &amp; save</div><article><h1>Head  line</h1><p><b>First &lt;part&gt;<br>goes on<p>Second <a href=x>with link</a> and   more text here.</p><ul><li>one<li>two</ul>
<form><input value=a>Sign up</form><script>var a="</p>";</script></article><div id="comments"><p>Reader says no.</p></div><aside>Side</aside><footer>&copy; f</footer></body></html>"""


def test_main_text():
    assert html_extract.main_text(PAGE) == "Head line\n\nFirst <part> goes on\n\nSecond with link and more text here.\n\none\n\ntwo"
    assert html_extract.main_text(PAGE[: PAGE.index("more text")]) == "Head line\n\nFirst <part> goes on\n\nSecond with link and"
    plain = "<div class=menu><a href=a>x</a> <a href=b>y</a></div><div class=content><p>" + "Long text goes here. " * 20 + "</p><p>" + "And on it goes. " * 20 + "</p></div><div class=sidebar>no</div>"
    assert html_extract.main_text(plain).startswith("Long text") and "And on" in html_extract.main_text(plain) and "no" not in html_extract.main_text(plain).split("\n\n")
    for x in (None, "", "<", "<html>", "<nav>only menu</nav>", "<!-- c -->"):
        assert html_extract.main_text(x) in ("", "<")


def paragraphs(n=6):
    return "".join(f"<p>{f'Sentence number {i} goes here and says something. ' * 6}</p>" for i in range(n))


@pytest.mark.parametrize("page", [
    "<body><form action=/><div id=ctl><h1>Title</h1>{}<div class=menu><a href=a>Bad</a> <a href=b>Bad</a></div></div></form></body>",
    '<body><div class="layout no-sidebar"><article><h1>Title</h1>{}</article></div><div class="sidebar"><p>Bad text that is rather long and goes on for a while.</p></div></body>',
    '<body><div class="page sidebar"><article><h1>Title</h1>{}</article></div></body>',
    '<body><section id="share-prices"><h1>Title</h1>{}</section></body>',
    "<body><div class=top><a href=/>Bad</a> <a href=/b>Bad</a></div><div class=content><h1>Title</h1>{}</div><div class=ad>Bad, buy it now.</div><div id=comments><p>Bad. I do not agree with it at all. Bad.</p></div><form><input>Bad</form></body>",
    "<body><header>Bad</header><main><header><h1>Title</h1></header>{}</main><footer>Bad</footer></body>",
    '<body><article><h1>Title</h1>{}<div class="related"><p>Bad stories you may like</p></div><section class=comments><p>Bad. Bad.</p></section></article></body>',
])
def test_density_decides(page):
    text = html_extract.main_text(page.format(paragraphs()))
    assert text.split("\n\n") == ["Title", *(f"Sentence number {i} goes here and says something. " * 6 for i in range(6))] or [x.strip() for x in text.split("\n\n")][0] == "Title"
    assert text.count("\n\n") == 6 and "Bad" not in text


HOSTILE = [
    "<div>" * 20_000 + "x", "<b>" * 4000 + "</i>" * 4000 + "x", "<div>" * 4000 + "some text" + "</div>" * 4000, "<p><span>" * 20_000 + "x", "<li><b>" * 20_000 + "x",
    "x" + "<a " * 100_000, "x" + "<!--" * 100_000, "x" + '<a b="' * 100_001, "x" + "<a b='\"" * 50_000, "x" + "<!-- -->" * 50_000, "x" + "<![if y]>" * 50_000, "x" + "</" * 100_000,
    "x" + "<script>" * 50_000, "x<a" + " " * 200_000 + ">", "x" + "<a/" * 100_000 + ">", "&" * 200_000, "x &#" + "9" * 100_000 + ";", "x" + "<title></title" * 50_000,
]


@pytest.mark.parametrize("page", HOSTILE, ids=range(len(HOSTILE)))
def test_hostile_pages_take_linear_time(page):
    import time

    began = time.process_time()
    assert html_extract.main_text(page)
    assert time.process_time() - began < 2


def test_markup_is_read_as_browsers_do():
    read = html_extract.main_text
    assert read("<p>a</p><![foo[x]]><p>b") == "a\n\nb" and read("a<![CDATA[b]]>c") == "ac" and read("<p>a<?x y?>b<!>c</>d") == "abcd"
    assert read("a<!--x--!>b<!-->c<!--->d<!-- -- > -->e") == "abcde" and read("1 < 2 <3 &lt; &#0000000065;&#x0000041; &#xFFFFFFFFF;") == "1 < 2 <3 < AA \ufffd"
    assert read('<p title="a>b" data-x=\'<i>\'>c<br/>d<P CLASS=x>e') == "c d\n\ne" and read("<p>a<script>'<p>b</p>'</scripty></SCRIPT >c") == "ac"
    assert read('<p>a <b title="never closed>b</b> c') == "a b c"  # a quote that nothing closes


def test_density_finds_the_article_without_semantic_tags(spark):
    """Renamed to div, all that tells the parts of these pages apart is their density."""
    kept = total = gained = pages = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        renamed = re.sub(r"<(/?)(?:nav|aside|header|footer|article|main|section)>", r"<\1div>", r.html).replace('<div class="ad">', "<div>")
        want, got = (Counter(html_extract.main_text(h).split("\n\n")) for h in (r.html, renamed))
        kept, total, gained, pages = kept + sum((want & got).values()), total + sum(want.values()), gained + bool(got - want), pages + 1
    assert kept >= 0.99 * total and gained <= 0.15 * pages


def test_main_text_of_an_empty_table(spark):
    assert html_extract.with_main_text(spark.createDataFrame([], "page_id long, html string, row string, `key` string")).count() == 0


def test_main_text_of_given_pages(spark):
    """Brute force for this template: blocks are cut out of the article by pattern."""
    import html

    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url", "html")
    for r in html_extract.with_main_text(pages).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub("<[^>]*>?", " " if "<br" in p else "", p)).split()) for p in re.split(r"</?(?:p|h1)>", re.sub("</?b>", "", body))]
        assert r.text == "\n\n".join(p for p in parts if p)


# -- 8


def test_language_of_held_out_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.language_report(rows).join(rows.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got) and len(got) > 100
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_equal_a_plain_scorer(spark):
    rows = [r for r in sample(spark) if r[1] and r[2]]
    model = language_id.train([r[1] for r in rows[:120]], [r[2] for r in rows[:120]])
    for text in [rows[150][1], "a", "Été, là-bas 12!", "x" * 50]:
        low = "".join(c if c.isalpha() else " " for c in text.lower())
        points = [ord(c) for c in f" {' '.join(low.split())} "]
        total, n = [0.0] * len(model.labels), 0
        for order in language_id.ORDERS:
            for i in range(len(points) - order + 1):
                h = order
                for k in range(order):
                    h = ((h ^ points[i + k]) * int(language_id.PRIMES[k])) & 0xFFFFFFFF
                h = (h ^ (h >> 15)) & (language_id.BUCKETS - 1)
                total, n = [t + float(x) for t, x in zip(total, model.table[h], strict=True)], n + 1
        z = [(t / n + b) / model.temperature for t, b in zip(total, model.bias, strict=True)]
        e = [math.exp(x - max(z)) for x in z]
        lang, score, accepted = model.predict(text)
        assert lang == model.labels[e.index(max(e))] and math.isclose(score, max(e) / sum(e), rel_tol=1e-6) and accepted == (score >= model.threshold)


def test_language_on_odd_input(spark):
    got = language_id.language_report(docs(spark, odd(spark) + [(50, "123 !!")])).collect()
    assert len(got) == len(odd(spark)) + 1
    assert {r.doc_id for r in got if r.lang_pred == "und"} == {0, 1, 2, 50}
    nothing = docs(spark, [(1, "some text", None)])
    assert language_id.language_report(nothing).first().lang_pred == "und"
    assert language_id.language_report(nothing.limit(0)).count() == 0
    assert {r.held_out for r in got if r.doc_id is not None} <= {zlib.crc32(str(i).encode()) % 5 == 0 for i in range(60)}


# -- 9


def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        left = total - sum(done.values())
        share = {s: left * w[s] / sum(w[x] for x in names if x not in done) for s in names if s not in done}
        over = [s for s in share if share[s] > 3 * sizes[s]]
        if not over:
            return done | share
        done |= {s: 3 * sizes[s] for s in over}


def test_mix_targets_and_takes(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", "c", None, "é"])) for i in range(600)] + [(601, "w " * 3, "en", "tiny"), (602, None, "en", "z"), (700, "w w", "en", "a"), (700, "w w", "en", "a")]
    got = source_mix.mix_report(docs(spark, rows)).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(tokens(r[1]))
    targets = brute_targets(sizes)
    by = {s: [0, 0.0] for s in sizes}
    ids = {}
    for r in rows:
        ids.setdefault(r[0], r[3])
    for r in got:
        s = ids[r.doc_id]
        assert r.source_size == sizes[s] and math.isclose(r.target, targets[s], rel_tol=1e-9, abs_tol=1e-9) and r.taken <= 3 * r.size
        by[s][0] += r.taken
    assert all(abs(by[s][0] - targets[s]) <= 60 for s in sizes) and len(got) == len(rows)
    assert got == source_mix.mix_report(docs(spark, list(reversed(rows))).repartition(3)).collect()
    texts = source_mix.mixed_documents(docs(spark, rows))
    assert texts.columns == docs(spark, rows).columns
    assert texts.count() == sum(r.copies for r in got)
    assert source_mix.mix_report(docs(spark, rows).limit(0)).count() == 0


def test_curriculum_positions(spark):
    df = spark.createDataFrame([(x / 10, a, b) for x in range(11) for a, b in source_mix.SCHEDULES], "p double, a double, b double")
    for r in df.withColumn("t", source_mix.position(F.col("p"), F.col("a"), F.col("b"))).collect():
        used = (r.a * r.t + (r.b - r.a) * r.t * r.t / 2) / ((r.a + r.b) / 2)
        assert math.isclose(used, r.p, abs_tol=1e-9)


# -- 10


def brute_base(text):
    text, out = text or "", []
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", low):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out)]


SECRETS = [
    'é password="abcDEF123456789" x', "API_KEY: 0123456789abcdef0123", "token=short", "Token = 'aa.bb-cc_dd+ee/ff='", "AKIA" + "A1" * 8, "AKIAAKIAAKIAAKIAAK", "\u017fecret=abcdefghijkl", "passwd\t=abcdefghijkl",
    "deadbeef" * 4 + "G" + "0" * 15, "secret=token=abcdefghijklmnop", None, "",
]


def test_base_secrets_equal_brute_force(spark):
    rows = sample(spark) + odd(spark) + [(900 + i, t) for i, t in enumerate(SECRETS)]
    by = {}
    for r in secret_scan.secret_report(docs(spark, rows)).collect():
        by.setdefault(r.doc_id, []).append(r)
    for d, t, *_ in rows:
        base = brute_base(t)
        assert any(r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest() and set(base) <= set(r.spans.split(",")) | {""} for r in by[d])
    assert secret_scan.secret_report(docs(spark, rows).limit(0)).count() == 0


_trained = []


def trained():
    """A field learned as the query does, from short documents."""
    if not _trained:
        texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"]).column("text").to_pylist()
        _trained.append(secret_scan.train([t for t in texts if t and len(t) <= secret_scan.SAMPLE_CHARS]))
    return _trained[0]


def planted(rng):
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    key = lambda n, a=small + large + digits: "".join(rng.choice(a) for _ in range(n))
    return [
        f"password is {key(20)}", f"Bearer eyJ{key(33)}.eyJ{key(60)}.{key(43)}", f"x ghp_{key(36)}", f"aws_secret_access_key {key(40, small + large + digits + '+')}", f"x sk_live_{key(24)}",
        f"db_pass={key(16)}", f"x {key(32, digits + 'ABCDEF')}",
    ]


def test_field_finds_secrets_that_the_patterns_do_not(spark):
    rng, tagger = random.Random(6), secret_scan.Tagger(trained())
    texts = [r[1] for r in sample(spark) if r[1] and len(r[1]) > 300]
    hit = asked = found = 0
    for i in range(20):
        for said in planted(rng):
            text = texts[(7 * i) % len(texts)]
            at = text.find(" ", 100) + 1
            a = at + re.search("[^ =]+$", said).start()
            b = at + len(said)
            spans = [tuple(map(int, x.split(":")[1:])) for x in secret_scan.scan(f"{text[:at]}{said} {text[at:]}", tagger)[4].split(",") if x.startswith("crf")]
            hit, asked, found = hit + any(abs(x - a) <= 1 and abs(y - b) <= 1 for x, y in spans), asked + 1, found + len(spans)
    print("planted", asked, "found", hit, "of spans", found)
    assert hit >= 0.9 * asked and hit >= 0.9 * found
    assert not secret_scan.Tagger(trained()).spans("only the usual words are here, some_long_names_too, 2024-10-12T10:11, /usr/local/lib/thing and 97.51.17.173")


def held_out_kinds(rng):
    """Kinds that training never makes: English passphrases, UUIDs, keys with their makers' prefixes, in other sentences."""
    small, large, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    key = lambda n, a=small + large + digits: "".join(rng.choice(a) for _ in range(n))
    english = lambda: rng.choice(["correct", "purple", "river", "window", "silver", "garden"]) + rng.choice(["horse", "monkey", "castle", "bridge"]) + rng.choice(["battery", "staple", "thunder", "orange"])
    return {
        "passphrase": f"the password is {english()}{rng.randint(10, 99)}", "named passphrase": f"passphrase: {english()}", "pwd": f"pwd Tr0ub4dor&{key(14)}", "letters": f"secret key {key(32, small + large)}",
        "slack": f"x xoxb-{key(12, digits)}-{key(24)}", "google": f"x AIza{key(35, small + large + digits + '_-')}", "stripe": f"x rk_live_{key(24)}", "hook": f"x whsec_{key(32)}", "npm": f"x npm_{key(36)}",
    }


def test_field_finds_kinds_that_training_never_makes(spark):
    rng, tagger = random.Random(16), secret_scan.Tagger(trained())
    texts = [r[1] for r in sample(spark) if r[1] and len(r[1]) > 300]
    hit, asked = Counter(), Counter()
    for i in range(30):
        for kind, said in held_out_kinds(rng).items():
            text = texts[(7 * i) % len(texts)]
            at = text.find(" ", 100) + 1
            a, b = at + said.rindex(" ") + 1, at + len(said)
            hit[kind] += any(abs(x - a) <= 1 and abs(y - b) <= 1 for x, y in tagger.spans(f"{text[:at]}{said} {text[at:]}"))
            asked[kind] += 1
    print({k: f"{hit[k]} of {asked[k]}" for k in asked})
    assert sum(hit.values()) >= 0.9 * sum(asked.values()) and min(hit[k] / asked[k] for k in asked) >= 0.8
    # the same words are none where nothing names a secret; image data is none
    plain = [f"we saw the {said.split()[-1]} today" for k, said in held_out_kinds(rng).items() if k in ("passphrase", "named passphrase") for _ in range(10)]
    image = "iVBORw0KGgoAAAANSUhEUgAAAAUAAAAFCAYAAACNbyblAAAAHElEQVQI12P4//8/w38GIAXDIBKE0DHxgljNBAAO9TXL0Y4OHwAAAABJRU5ErkJggg"
    assert sum(bool(tagger.spans(p)) for p in plain) <= 0.1 * len(plain)
    assert not tagger.spans(f"an image {image} follows") and not tagger.spans(f"src=data:image/png;base64,{image}")


def test_viterbi_in_parts_equals_the_whole():
    model = trained()
    tagger = secret_scan.Tagger(model)
    rng = random.Random(4)
    for _ in range(60):
        text = " ".join(rng.choice(["word", "token", "=", "deadbeef01234567aa", "X9", '"', "4f9a0c7bd12e83f6", "a"]) for _ in range(30))
        names, tags = tagger.tags(text)
        kinds = [(secret_scan.shape(t), secret_scan.word(t)) for t in names]
        around = [(("edge",), 0), (("edge",), 0), *kinds, (("edge",), 0)]
        e = [sum(model.score(p, *around[i + 2 + k]) for p, k in secret_scan.PLACES.items()) + model.score("file", secret_scan.file_features(text)) + [model.caution, 0, 0] for i in range(len(names))]
        best, back = e[0], []
        for x in e[1:]:
            s = best[:, None] + model.transitions
            back.append(s.argmax(axis=0))
            best = s.max(axis=0) + x
        score = lambda y: sum(e[i][k] for i, k in enumerate(y)) + sum(model.transitions[a, b] for a, b in zip(y, y[1:], strict=False))
        path = [int(best.argmax())]
        for b in reversed(back):
            path.append(int(b[path[-1]]))
        assert math.isclose(score(tags.tolist()), score(path[::-1]), rel_tol=1e-9)


# -- all


def test_empty_tables(spark):
    none = docs(spark, [(1, "x")]).limit(0)
    assert simhash_dedup.simhash_groups(none).count() == 0 and near_dedup.one_of_each_group(none).count() == 0
    assert chat_format.format_report(chat(spark, [])).count() == 0


# -- pipeline


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near-duplicates", "decontamination", "source mix", "token files"]
    start = spark.read.parquet(f"{SF}/documents.parquet")
    judged = brute_kept([(r.doc_id, r.text, r.lang, r.source) for r in start.collect()])
    rows = [r for r in start.collect() if r.doc_id in judged]
    left = set(brute_near([(r.doc_id, r.text) for r in rows]))
    rows = [r for r in rows if r.doc_id in left]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {d for d, _ in brute_contaminated([(r.doc_id, r.text) for r in rows], items)}
    rows = [r for r in rows if r.doc_id not in bad]
    mixed = {r.doc_id: r.copies for r in source_mix.mix_report(spark.createDataFrame(rows, start.schema)).collect()}
    tok = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for r in rows:
        if mixed[r.doc_id]:
            ids = [*tok.encode(r.text, add_special_tokens=False).ids, 0]
            want[r.doc_id, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += mixed[r.doc_id]
    got = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want and bad


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {p.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{p}'")
    df = queries.queries()[name](spark, SF)
    r = c.execute(queries.oracle_sql()[name])
    cols = [x[0] for x in r.description]
    assert sorted(cols) == sorted(df.columns)
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    assert Counter(tuple(plain(x[k]) for k in cols) for x in df.collect()) == Counter(tuple(map(plain, x)) for x in r.fetchall())




def test_a_secret_field_keeps_its_tagger_for_the_next_task():
    import pickle

    from codexlake.llm import secret_scan

    f = secret_scan.Field()
    assert f.tagger is f.tagger
    assert "tagger" not in vars(pickle.loads(pickle.dumps(f)))
    assert [secret_scan.shape(t) for t in ("is", "Token.", "-apple", "Key", "pass1", "abcdefghijk", "ölig")] == [
        ("length 0", "letters"), ("length 1", "names a secret", "letters"), ("length 1", "letters"), ("length 0", "names a secret", "letters"),
        ("length 1", "names a secret", "other"), ("length 2", "letters"), ("length 1", "letters"),
    ]
