"""MinHash, the prefix trie and vector codes against brute force, and on odd input."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codexlake.llm import minhash, near_dedup, prefix_trie, queries, vector_codes

SF = "/root/testdata/sf0.001"
#: Extra columns whose names the operators use themselves.
DOC = "doc_id long, text string, node long, `range` long, extra string, hash string, fingerprint string, class_id string, n int"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "e", "h", "f", "c", 3) for r in rows], DOC)


# -- 11


def plain_shingles(text):
    w = (text or "").lower().encode().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def brute_classes(rows):
    sets = [plain_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return Counter((r[0], least.get(find(i))) for i, r in enumerate(rows))


def brute_edited(rows):
    """(id, n_chars, sha256) with each text beside the next in order of id; rows have unique ids."""
    rows = sorted((i, t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        half = len(t) // 2
        new = t[: len(t) - half] + rows[(k + 1) % len(rows)][1][:half]
        out.append((i, len(t), hashlib.sha256(new.encode()).hexdigest()))
    return Counter(out)


def near_rows():
    """Changed words at distances around 0.8, one large group of near-copies, a passage in many texts, copies."""
    rng = random.Random(5)
    make = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    texts, passage = [], make(60)
    for i in range(10):
        base = make(60 + 10 * i)
        texts += [base] + [[f"x{k}" if k % (20 * j) == 7 else w for k, w in enumerate(base)] for j in range(1, 6)] + [base[: len(base) * 4 // 5 + 1], base + make(12)]
    core = make(100)
    texts += [[*core[:at], f"y{at}", *core[at + 1 :]] for at in range(60)]
    texts += [passage + make(k % 14 + 1) for k in range(60)] + [make(10) + passage for _ in range(20)]
    rows = [" ".join(t) for t in texts]
    rows = [*rows, rows[3], rows[3], rows[3].upper(), None, "", " ", "one two", "One  two", "a b c d e", "日本 語 é ü ß 𝄞 x", "z" * 3000]
    rng.shuffle(rows)
    return [(7 * i - 100, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("few", [4, near_dedup.FEW])
def test_fingerprint_report_equals_brute_force(spark, few, monkeypatch):
    monkeypatch.setattr(minhash.similar_groups, "__defaults__", (few,))
    rows = near_rows()
    got = minhash.fingerprint_report(docs(spark, rows)).collect()
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == brute_edited(rows)
    assert Counter((r.doc_id, r.class_id) for r in got) == brute_classes(rows)
    by_id, text = {r.doc_id: r for r in got}, dict(rows)
    order, off = sorted(text), []
    for a, b in zip(order, [*order[1:], order[0]], strict=True):
        off.append(by_id[a].near_next - jaccard(plain_shingles(text[a]), plain_shingles(text[b])))
        assert by_id[a].fingerprint == minhash.fingerprint(text[a]).tobytes().hex()
    assert max(map(abs, off)) < 0.2 and abs(sum(off)) / len(off) < 0.01
    copies = defaultdict(set)
    for r in got:
        copies[text[r.doc_id]].add(r.fingerprint)
    assert {len(x) for x in copies.values()} == {1}


def test_equal_ids_null_ids_and_one_or_no_document(spark):
    odd = [(3, "one"), (3, "one"), (3, "two three"), (None, "no id"), (None, None), (None, "no id"), (1, "long " * 30_000)]
    got = minhash.fingerprint_report(docs(spark, odd)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd)
    assert {r.class_id for r in got if r.n_chars == 3} == {3} and {r.class_id for r in got if r.doc_id is None} == {None}
    alone = minhash.fingerprint_report(docs(spark, [(5, "abcd efgh")])).first()
    assert alone.near_next == 1.0 and alone.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest()
    assert minhash.fingerprint_report(docs(spark, [])).collect() == []
    named = spark.createDataFrame([("b", "x y"), ("a", "p q"), (None, "")], "doc_id string, text string")
    got = {r.doc_id: r.edited_sha256 for r in minhash.fingerprint_report(named).collect()}
    assert got == {"a": hashlib.sha256(b"p x").hexdigest(), "b": hashlib.sha256(b"x ").hexdigest(), None: hashlib.sha256(b"").hexdigest()}


def test_permutations_are_those_of_whole_numbers(spark):
    x = np.array([5, -7, 1 << 62, 123456789], np.int64)
    high = [(int(v) % (1 << 64)) >> 32 for v in x]
    for i in (0, 17, 127):
        a, b = int(minhash.FACTORS[i, 0]), int(minhash.ADDENDS[i, 0])
        assert minhash.signature(x)[i] == (min((a * v + b) % (1 << 64) for v in high) >> 32) & 0xFFFF


# -- 12


def plain_trie(rows):
    """Nodes from all (conv_id, turn, role, text), with ties of a turn in the operator's order."""
    own = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append(((n is not None, n or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, full = defaultdict(list), defaultdict(list)
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        path = own.get(c - c % 100, [])[:h] + t[h:]
        full[tuple(path)].append(c)
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids, leaves, saved = Counter(p[:-1] for p in members if p), Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], sha(full[p])) for p, m in members.items())


NODE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def trie_rows(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], "conv_id long, turn long, role string, text string, depth int, path string, h int")
    return Counter(tuple(r[c] for c in NODE) for r in prefix_trie.trie_report(df).select(*NODE).collect())


def chats(n=260):
    rng = random.Random(3)
    rows = []
    for c in range(n):
        kind = c % 7
        for t in range(rng.randrange(0, 9) if kind else 6):
            text = ["", "hello", None, "same"][t % 4] if kind < 4 else f"t{rng.randrange(3)}" * rng.randrange(1, 4)
            rows.append((c, rng.choice([t, t, None]), ["user", "assistant", None][t % 3], text))
    rows += [(500 + i, t, "user", f"deep {t}") for i in range(3) for t in range(300 + i)]  # long ones
    rows += [(1000 + i, 0, "user", "hot") for i in range(300)] + [(5, 1, "user", "twice")] * 3 + [(None, 0, "user", "nobody's")] * 2
    return rows


def test_trie_equals_brute_force(spark):
    rows = chats()
    assert trie_rows(spark, rows) == plain_trie(rows)
    assert trie_rows(spark, []) == Counter()
    assert trie_rows(spark, [(7, 0, "user", "x")]) == plain_trie([(7, 0, "user", "x")])


@pytest.mark.parametrize("shards", [2, 40])
def test_trie_is_the_same_in_any_number_of_shards(spark, shards, monkeypatch):
    """Cuts at short paths too, so that many spines cross shards."""
    rows = chats(150)
    monkeypatch.setattr(prefix_trie, "SHARD_NODES", 1 if shards > 2 else 1 << 40)
    monkeypatch.setattr(prefix_trie, "CUT_TURNS", 3 if shards == 2 else 256)
    monkeypatch.setattr(prefix_trie, "IDS", 7)
    few = prefix_trie._cuts
    monkeypatch.setattr(prefix_trie, "_cuts", lambda p: (few(p)[0][:: max(1, len(few(p)[0]) // shards)], 4))
    assert trie_rows(spark, rows) == plain_trie(rows)


def test_parentheses_close_where_a_stack_says():
    rng = random.Random(1)
    for n in (1, 2, 40, 3000):
        bits, open_ = [], 0
        while len(bits) < 2 * n:
            if open_ and (2 * n - len(bits) == open_ or rng.random() < 0.45):
                bits.append(False)
                open_ -= 1
            else:
                bits.append(True)
                open_ += 1
        stack, close = [], {}
        for i, b in enumerate(bits):
            if b:
                stack.append(i)
            else:
                close[stack.pop()] = i
        tree = prefix_trie.Parens(np.array(bits))
        at = tree.opens()
        assert tree.find_close(at).tolist() == [close[i] for i in at.tolist()]
        rank = tree.leaf_rank(np.ones(len(bits), np.int64))
        assert rank[-1] == sum(bits[i] and not bits[i + 1] for i in range(len(bits) - 1))


# -- 13


def plain_codes(rows):
    """Codes, errors and books by Python's whole numbers."""
    rows = [(i, lab, [int(np.floor(1024 * float(x))) for x in v]) for i, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(rows[0][2]) // 4
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[2], p) for r in rows[:256]] for p in range(4)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v, p: min((dist(cut(v, p), e), j) for j, e in enumerate(books[p]))
    for _ in range(4):
        new = []
        for p in range(4):
            of = defaultdict(list)
            for r in rows:
                of[near(r[2], p)[1]].append(cut(r[2], p))
            new.append([[sum(c) // len(of[j]) for c in zip(*of[j], strict=True)] if j in of else e for j, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[near(r[2], p) for p in range(4)] for r in rows]
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for r, e in zip(rows, errors, strict=True):
        by_label[r[1]] += e
    return Counter((r[0], "".join(f"{j:02x}" for _, j in f), e, by_label[r[1]], sha) for r, f, e in zip(rows, found, errors, strict=True))


CODE = ("vec_id", "code", "error", "label_error", "codebooks_sha256")


def codes(spark, rows):
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "vec_id long, embedding array<float>, label int, code string, id int")
    return Counter(tuple(r) for r in vector_codes.code_report(df).select(*CODE).collect())


@pytest.mark.parametrize("scale", [1.0, 1e5])
def test_codes_equal_whole_number_arithmetic(spark, scale):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(330, 8)) * scale).astype(np.float32)
    v[100:160] = v[:60]  # ties
    rows = [(i, x.tolist(), int(i % 3) if i % 5 else None) for i, x in enumerate(v)]
    bad = [(-1, None, 1), (-2, [1.0] * 7 + [None], 1), (-3, [1.0] * 7 + [float("nan")], 1), (-4, [float("inf")] + [0.0] * 7, None)]
    rows += [(5, v[7].tolist(), 1), (5, v[7].tolist(), 1), (None, v[9].tolist(), None)]
    assert codes(spark, rows + bad) == plain_codes(rows)
    assert codes(spark, bad) == Counter() and codes(spark, []) == Counter()


def test_other_lengths_and_immense_components_are_dropped(spark):
    rows = [(i, [float(i), 0.5, -0.25, 2.0], 0) for i in range(5)]
    assert codes(spark, [*rows, (9, [1.0] * 5, 0), (10, [3e38, 0.0, 0.0, 0.0], 0), (11, [], 0)]) == plain_codes(rows)


@pytest.mark.parametrize("high", [3, 1 << 13, 1 << 25, vector_codes.largest(16)])
def test_products_of_limbs_are_exact(high):
    rng = np.random.default_rng(high)
    a, b = (rng.integers(-high, high + 1, (n, 16)) for n in (40, 9))
    a[0], b[0] = high, -high
    want = [[sum(int(x) * int(y) for x, y in zip(p, q, strict=True)) for q in b] for p in a]
    assert vector_codes.exact_product(a, b).tolist() == want
    back = sum(x.astype(object) * (1 << (24 * i)) for i, x in enumerate(vector_codes.limbs(a, 24)))
    assert (back == a).all()


def test_decoded_vectors_are_as_far_as_the_error_says(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet").limit(100)
    coded, books = vector_codes.compressed(df)
    rows = {r.id: r for r in coded.collect()}
    for r in df.collect():
        v = [int(np.floor(1024 * x)) for x in r.embedding]
        assert sum((x - y) ** 2 for x, y in zip(v, vector_codes.decoded(rows[r.vec_id].code, books), strict=True)) == rows[r.vec_id].error


def test_registered(spark):
    assert {"op11_minhash", "op12_prefix_trie", "op13_vector_codes"} <= set(queries.queries())
    assert queries.op13_vector_codes(spark, SF).columns == list(CODE) and queries.op12_prefix_trie(spark, SF).columns == list(NODE)


# -- all


def test_extra_columns_of_any_name_change_nothing(spark):
    """Every document operator's report, beside a table whose extra columns have the names of its own and inner columns."""
    from codexlake.llm import language_id, quality_rules, secret_scan, simhash_dedup, source_mix, token_output

    rng = random.Random(4)
    rows = [(i, " ".join(f"word{rng.randrange(40)}" for _ in range(rng.randrange(1, 90))), ["en", "de", None][i % 3], f"s{i % 4}") for i in range(60)]
    rows += [(3, None, None, None), (None, "", "en", "s1"), rows[5], rows[5]]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = (
        "node n_words kept start size taken position component_id fingerprint hash row key id item_id window shingle all total tokens spans secrets language score target copies rank place slot "
        "_q _w _base _t measure bucket u v n parity root class_id least extra range held_out lang_pred base_failed n_tokens order_0 text_sha256 word"
    ).split()
    clashing = plain.withColumns({c: F.lit("x") for c in names})
    tokenizer = queries.tokenizer_path()
    reports = {
        "op1": simhash_dedup.simhash_groups, "op4": quality_rules.quality_report, "op6": lambda d: token_output.tokenized(d, tokenizer), "op8": language_id.language_report,
        "op9": source_mix.mix_report, "op10": secret_scan.secret_report, "op11": minhash.fingerprint_report,
    }
    for name, report in reports.items():
        a, b = report(plain), report(clashing)
        assert a.columns == b.columns, name
        assert Counter(map(str, a.collect())) == Counter(map(str, b.collect())), name
    for keep in (quality_rules.keep_good, near_dedup.one_of_each_group, source_mix.mixed_documents, simhash_dedup.one_of_each_group):
        a, b = keep(plain), keep(clashing)
        assert b.columns == clashing.columns and Counter(map(str, a.collect())) == Counter(map(str, b.select(*plain.columns).collect())), keep


def test_item_and_record_tables_with_clashing_names(spark):
    from codexlake.llm import chat_format, decontaminate

    long = " ".join(f"w{i}" for i in range(30))
    plain = spark.createDataFrame([(1, f"a b {long} c"), (2, "other text"), (None, long)], "doc_id long, text string")
    items = spark.createDataFrame([(7, long)], "item_id long, text string")
    names = "name n_words start window print all total shingle item_shingles key hash row reach part at similarity".split()
    clash = lambda df: df.withColumns({c: F.lit("x") for c in names})
    a, b = decontaminate.contamination_report(plain, items), decontaminate.contamination_report(clash(plain), clash(items))
    assert Counter(map(str, a.collect())) == Counter(map(str, b.collect())) and a.count() == 2
    kept = decontaminate.clean_documents(clash(plain), clash(items))
    assert kept.columns == clash(plain).columns and [r.doc_id for r in kept.collect()] == [2]
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "ho")], "conv_id long, turn int, role string, text string")
    more = talk.withColumns({c: F.lit("x") for c in "m record layout turns formatted loss_spans n path lens name h head t chars".split()})
    for report in (chat_format.format_report, prefix_trie.trie_report):
        assert Counter(map(str, report(talk).collect())) == Counter(map(str, report(more).collect()))
