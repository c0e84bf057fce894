"""Language mixtures, dual-tree search and dialogue repair against plain loops."""

import collections
import hashlib
import heapq
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from asofia.llm import base, blob_ledger, dialogue_repair as dr, dual_tree_search as dt, grammar, language_mixture as lm, near_dedup, units
from asofia.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SMALL = "/root/testdata/sf0.01"
ODD = [None, "", " ", "\n\n", "a", "A b-c 1_2", "x" * 100_000, "word " * 20_000, "é漢字 \x1c\u0085　 don't  ", "same text here twice", "same text here twice", "١٢٣ 42", "́"]


def frame(spark, texts, first=0):
    """Documents with clashing extra columns; the last row has no id."""
    rows = [(first + i, t, "en", len(t or ""), i, "x", 0.5) for i, t in enumerate(texts)] + [(None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long, n int, terms string, score double")


def same_as_sql(spark, name, path, tables):
    build, sql = QUERIES[name]
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet')")
    got = build(spark, path)
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    return sorted(tuple(r[c] for c in names) for r in got.collect()) == sorted(cursor.fetchall())


# ---- language mixtures -----------------------------------------------------

def plain_grams(text):
    """Windows of three over lower-case letters and marks, one space for anything else."""
    import unicodedata
    kinds = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text or "")
    words = kinds.split(" ")
    s = " " + " ".join("".join(c.lower() if len(c.lower()) == 1 else c for c in w) for w in words if w) + " "
    return [s[i:i + 3] for i in range(len(s) - 2)] if s.strip() else []


def test_ngrams_are_those_of_a_plain_loop():
    texts = ODD + ["Ünder ÄÖ, straße!\nΣΑΣ"]
    bucket, doc, lettered = lm.ngrams(texts)
    seen = {}
    for i, t in enumerate(texts):
        own = bucket[doc == i].tolist()
        want = plain_grams(t)
        assert len(own) == len(want)
        for g, b in zip(want, own):
            assert seen.setdefault(g, b) == b
        assert lettered[i] == any(c.isalpha() for c in t or "")
    assert lm.ngrams([])[0].size == 0


def test_expectation_maximisation_is_that_of_a_plain_loop():
    rng = np.random.default_rng(3)
    p, c, doc = rng.random((30, 3)), rng.integers(1, 5, 30).astype(float), np.sort(rng.integers(0, 3, 30))
    doc[:3] = [0, 1, 2]
    doc.sort()
    got, like = lm.expectation_maximisation(p, c, doc, np.full((3, 3), 1 / 3))
    for d in range(3):
        own, pi = np.flatnonzero(doc == d), [1 / 3] * 3
        for _ in range(2_000):
            new = [0.0] * 3
            for e in own:
                s = sum(pi[k] * p[e, k] for k in range(3))
                for k in range(3):
                    new[k] += c[e] * pi[k] * p[e, k] / s
            pi = [x / c[own].sum() for x in new]
        best = sum(c[e] * math.log(sum(pi[k] * p[e, k] for k in range(3))) for e in own)
        assert like[d] <= best + 1e-9 and best - like[d] < 0.1
        assert abs(got[d].sum() - 1) < 1e-9


def test_mixed_texts_get_both_languages_and_the_larger_one(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = lm.train(docs)
    by = {lang: [r.text for r in docs.where((F.col("lang") == lang) & (F.length("text") > 2_000)).orderBy("doc_id").limit(3).collect()] for lang in model.names}
    for a, b in itertools.permutations(model.names, 2):
        pi, known = lm.mixtures([by[a][0][:1_400] + " " + by[b][0][:600], by[a][1]], model)
        top = [model.names[i] for i in np.argsort(-pi[0])[:2]]
        assert known.all() and top == [a, b] and 0.5 < pi[0].max() < 0.9
        assert model.names[pi[1].argmax()] == a
        # the chosen set is worth more than any single language
        bucket, doc, _ = lm.ngrams([by[a][0][:1_400] + " " + by[b][0][:600]])
        table = model.table.astype(np.float64)[bucket]
        penalty = lm.N * math.log(len(bucket))
        chosen = np.log(table @ pi[0]).sum() - penalty * (pi[0] > 0).sum()
        assert chosen > max(np.log(table[:, k]).sum() - penalty for k in range(len(model.names)))


def test_language_query_on_held_out_rows(spark):
    found = QUERIES["op11_language_mixture"][0](spark, SMALL)
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    rows = found.join(truth, "doc_id").collect()
    assert len(rows) == truth.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_language_odd_rows(spark):
    model = lm.train(spark.createDataFrame([("en", "the house and the garden"), ("fr", "la maison et le jardin"), (None, "x"), ("de", None)], "lang string, text string"))
    assert model.names == ["en", "fr"]
    rows = {r.doc_id: r for r in lm.predict(frame(spark, ODD), model).collect()}
    for i, t in enumerate(ODD):
        assert (rows[i].lang_pred == lm.UNKNOWN) == (not any(c.isalpha() for c in t or "")) and 0 <= rows[i].score <= 1
    assert len(rows) == len(ODD) + 1
    nothing = lm.train(spark.createDataFrame([], "lang string, text string"))
    assert {r.lang_pred for r in lm.predict(frame(spark, ["a text"]), nothing).collect()} == {lm.UNKNOWN}
    assert lm.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_slices_do_not_change_mixtures(monkeypatch, spark):
    model = lm.train(spark.read.parquet(f"{SF}/documents.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ODD
    want, _ = lm.mixtures(texts, model)
    monkeypatch.setattr(lm, "ENTRIES", 64)
    got, _ = lm.mixtures(texts, model)
    assert np.allclose(got, want, atol=0.02) and (got.argmax(1) == want.argmax(1)).all()


# ---- dual-tree search ------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain_rank(items, docs, k):
    """items: id -> texts; docs: (doc_id, text) rows."""
    counted = [(d, collections.Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    n_docs, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = collections.Counter(t for _, c in counted for t in c)
    out = []
    for item, texts in items.items():
        terms = {t for text in texts for t in plain_terms(text)}
        scored = []
        for d, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in terms if c[t])
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, r, d, -s) for r, (s, d) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out)


def ranked(df):
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


def test_terms_of_odd_texts():
    for t in ODD + ["A-Za-z 0x7F\x7f€ \x00y", "ÀÉ Straße"]:
        assert [x.decode() for x in dt.terms_of(t)] == plain_terms(t)


def random_case(seed, n_docs=300, n_items=25):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["é", "Ab", "漢"]
    text = lambda n: " ".join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=n))
    docs = [(rng.choice([i, i, i, 7, None]), rng.choice([text(rng.randint(0, 40)), text(3), None, "w1 w2 w3 w4"])) for i in range(n_docs)]
    items = {i: [text(rng.randint(0, 12)) for _ in range(rng.choice([1, 1, 2]))] for i in range(n_items)}
    return items, docs


@pytest.mark.parametrize("seed, k, cells, group_bytes", [(1, 5, 1 << 23, 1 << 18), (2, 3, 16 * 70, 1 << 18), (3, 50, 64 * 70, 300)])
def test_search_is_that_of_a_plain_loop(spark, monkeypatch, seed, k, cells, group_bytes):
    monkeypatch.setattr(dt, "SEED_DOCS", 20)
    items, docs = random_case(seed)
    monkeypatch.setattr(dt, "CELLS", cells)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, n int, item_id string").repartition(3)
    i = spark.createDataFrame([(i, t, 0) for i, ts in items.items() for t in ts] + [(None, "w1", 0), (99, None, 0)], "item_id long, text string, score int")
    assert ranked(dt.rank(i, d, k, group_bytes)) == plain_rank(items, docs, k)


def test_whole_batches_are_pruned_and_nothing_is_lost(monkeypatch):
    items, docs = random_case(5, 4_000, 40)
    docs = [(i, t) for i, (_, t) in enumerate(docs)]
    vocabulary = sorted({t.encode() for ts in items.values() for x in ts for t in plain_terms(x)})
    number = {t: i for i, t in enumerate(vocabulary)}
    counted = [(d, len(dt.terms_of(t)), collections.Counter(number[x] for x in dt.terms_of(t) if x in number)) for d, t in docs if dt.terms_of(t)]
    df = collections.Counter(t for _, _, c in counted for t in c)
    n_docs = len(counted)
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in range(len(vocabulary))], np.int64)
    search = dt.Search([np.array(sorted({number[t] for x in ts for t in dt.terms_of(x)}), np.int64) for ts in items.values()], weight, n_docs, sum(n for _, n, _ in counted), 5)
    trees = dt.Trees(search, np.ones(len(items), np.int64))
    for a in range(0, n_docs, 500):
        part = counted[a:a + 500]
        terms = [sorted(c) for _, _, c in part]
        trees.add(np.array([d for d, _, _ in part]), np.array([n for _, n, _ in part]), np.r_[0, np.cumsum(list(map(len, terms)))],
                  np.array([t for own in terms for t in own], np.int64), np.array([c[t] for own, (_, _, c) in zip(terms, part) for t in own], np.int64))
    got = sorted((i, s, d) for i, (ss, ds) in enumerate(trees.found) for s, d in zip(ss.tolist(), ds.tolist()))
    assert got == sorted((i, s, d) for i, _, d, s in plain_rank(items, docs, 5))
    assert trees.scored < 0.5 * trees.pairs


def test_search_empty_tables_and_query(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b"), (2, ""), (3, None)], "item_id long, text string")
    assert dt.rank(items, none).count() == 0
    assert dt.rank(spark.createDataFrame([], "item_id long, text string"), frame(spark, ODD)).count() == 0
    assert ranked(dt.rank(items, frame(spark, ODD), 4)) == plain_rank({1: ["a b"], 2: [""]}, [*enumerate(ODD), (None, "no id at all")], 4)
    assert same_as_sql(spark, "op12_dual_tree_search", SF, ("documents", "benchmark"))


# ---- dialogue repair -------------------------------------------------------

BLANKS = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], r[3]))


def brute(rows):
    """(faults, cost, edits, lines) by trying every state with memory of the least (cost, edits)."""
    seen, faults = set(), []
    for _, role, text in rows:
        end = text.rstrip(BLANKS)
        faults.append("b" if not end else "d" if (role, text) in seen else "t" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}
    heap, best = [(0, "", "", 0, ())], {}
    while heap:   # least (cost, edits) first
        cost, audit, last, i, lines = heapq.heappop(heap)
        if (last, i) in best:
            continue
        best[last, i] = cost, audit, lines
        steps = [(2, "I", r, 0, f"{name}:") for r, name in (("u", "user"), ("a", "assistant")) if r in follows[last]]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append((3, "D", last, 1, None))
            if faults[i] not in ("b", "d"):
                t = faults[i] == "t"
                if role[:1] and role[0] in follows[last]:
                    steps.append((int(t), "K", role[0], 1, f"{role}:{text}"))
                steps += [(2 + t, "R", r, 1, f"{name}:{text}") for r, name in (("u", "user"), ("a", "assistant")) if r in follows[last]]
        for c, edit, state, step, line in steps:
            heapq.heappush(heap, (cost + c, audit + edit, state, i + step, lines if line is None else (*lines, line)))
    return faults, *min(best[s, len(rows)] for s in ("", "a") if (s, len(rows)) in best)


def expected(rows):
    """conv_id -> result, from (conv_id, turn, role, text) rows before damage."""
    out = {}
    after = plain_damage(rows)
    for conv in {r[0] for r in rows}:
        own = [r[1:] for r in after if r[0] == conv]
        faults, cost, audit, lines = brute(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, count=150, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        for turn in range(rng.randint(1, most)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rng.choice(["One.", "Two!", "three", " ", "", None, f"Text {rng.randint(0, 9)}?", "end. \n", "漢字。"])))
    return rows + [(None, 0, "user", "No id."), (None, 1, "user", "No id.")]


SCHEMA = "conv_id long, turn long, role string, text string"


def as_dict(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r.conv_id: tuple(r[c] for c in names) for r in df.collect()}


def test_walk_with_checkpoints_is_the_least_of_all_edit_lists():
    rng = random.Random(8)
    for _ in range(3_000):
        rows = [(rng.choice("ssuuaax"), rng.choice([0, 0, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(0, 12))]
        # every edit list as text, by the plain recursion over rows and states
        follows = {dr.START: {"s": 1, "u": 2}, dr.SYSTEM: {"u": 2}, dr.USER: {"a": 3}, dr.ASSISTANT: {"u": 2}}
        memory = {}

        def least(i, q, inserts=0):
            if (i, q, inserts) in memory:
                return memory[i, q, inserts]
            options = [(0, "")] if i == len(rows) and q in (dr.START, dr.ASSISTANT) else []
            if inserts < 2:
                options += [(c + 2, "I" + a) for c, a in [least(i, dr.TURN_AFTER[q], inserts + 1)]]
            if i < len(rows):
                initial, fault, copies = rows[i]
                rest, tail = 3 * (copies - 1), "D" * (copies - 1)
                go = lambda to, cost, edit: options.append((least(i + 1, to)[0] + cost + rest, edit + tail + least(i + 1, to)[1]))
                go(q, 3, "D")
                if fault < dr.BLANK:
                    go(dr.TURN_AFTER[q], 2 + (fault == 1), "R")
                    if initial in follows[q]:
                        go(follows[q][initial], int(fault == 1), "K")
            memory[i, q, inserts] = min(options, default=(dr.FAR, ""))
            return memory[i, q, inserts]

        cut = rng.randint(0, len(rows))
        middle = dr.apply(dr.matrix(rows[cut:]), dr.END)
        assert dr.apply(dr.matrix(rows), dr.END)[dr.START] == least(0, dr.START)[0]
        state, audit = dr.START, ""
        for part, after in ((rows[:cut], middle), (rows[cut:], dr.END)):
            for i, edit, state in dr.walk(part, after, state):
                audit += edit + ("D" * (part[i][2] - 1) if edit != "I" else "")
        audit += {dr.SYSTEM: "II", dr.USER: "I"}.get(state, "")
        assert audit == least(0, dr.START)[1]


@pytest.mark.parametrize("seed, most_rows", [(1, 4_096), (2, 1), (3, 3)])
def test_repair_is_that_of_a_plain_search(spark, monkeypatch, seed, most_rows):
    monkeypatch.setattr(dr.segments, "__defaults__", (most_rows, 1 << 20))
    rows = conversations(seed)
    df = spark.createDataFrame([(*r, 1, "x", 0) for r in rows], SCHEMA + ", copies int, fault string, seg int").repartition(4)
    assert as_dict(dr.repair(df)) == expected(rows)


def test_one_long_conversation_over_many_segments(spark, monkeypatch):
    monkeypatch.setattr(dr.segments, "__defaults__", (16, 200))
    rng = random.Random(4)
    rows = [(5, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"Text {t}.", "Again.", "cut", ""])) for t in range(1_500)] + [(6, 0, "user", "Hi."), (6, 1, "assistant", "Yes.")]
    got = as_dict(dr.repair(spark.createDataFrame(rows, SCHEMA).repartition(7)))
    assert got == expected(rows)


def test_repair_of_dropped_and_empty_conversations(spark):
    dropped = next(c for c in range(1_000) if all(zlib.crc32(f"{c}:{t}".encode()) % 20 == 0 for t in (0,)))
    got = as_dict(dr.repair(spark.createDataFrame([(dropped, 0, "user", "Gone.")], SCHEMA)))
    assert got == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert dr.repair(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repair_query_equals_sql(spark):
    assert same_as_sql(spark, "op13_dialogue_repair", SMALL, ("conversations",))


# ---- near duplicates, redaction, units, shards -------------------------------

def test_a_text_goes_only_if_another_document_stands_for_it(spark):
    a, b = "one two three four five six seven eight nine ten", "red green blue white black brown pink grey gold violet"
    docs = spark.createDataFrame([(5, a, 1, "x"), (5, b, 2, "y"), (3, b, 3, "z"), (None, b, 4, "w"), (9, None, 5, "v")], "doc_id long, text string, gone_id int, GONE_KEY string")
    kept = sorted((str(r.doc_id), str(r.text), r.gone_id) for r in near_dedup.drop_duplicates(docs).collect())
    assert kept == sorted([("5", a, 1), ("3", b, 3), ("None", b, 4), ("9", "None", 5)])
    assert near_dedup.drop_duplicates(docs.limit(0)).count() == 0


def test_blocks_unite_without_losing_a_link(spark, monkeypatch):
    rng = random.Random(12)
    words = [f"w{i}" for i in range(60)]
    docs = []
    for i in range(260):   # one hot group of edited copies, cut into many small blocks
        text = list(words)
        for _ in range(rng.randint(0, 4)):
            text[rng.randrange(60)] = f"x{rng.randrange(40)}"
        docs.append((i, " ".join(text)))
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    sets = near_dedup.shingle_sets([t for _, t in docs])
    name = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if near_dedup.linked(sets[i], sets[j], 80) and name[i] != name[j]:
                low, high = min(name[i], name[j]), max(name[i], name[j])
                name = [low if x == high else x for x in name]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4)).collect()}
    assert sum(got[i] != name[i] for i in range(len(docs))) <= 2    # candidates come from hashed bands


def test_redaction_with_clashing_columns_and_a_hot_text(spark):
    secret = "token = abcdefgh1234 here"
    docs = spark.createDataFrame([(i, secret if i % 2 else f"clean {i}", "b", "s", 1) for i in range(60)] + [(None, None, "b", "s", 1)],
                                 "doc_id long, text string, _blob string, blob string, SALT int")
    out = blob_ledger.redact(docs, blob_ledger.extend_ledger(spark, docs, base.shared_folder(spark)))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 61 and all("abcdefgh1234" not in (r.text or "") and r.blob == "s" and r._blob == "b" and r.SALT == 1 for r in rows)
    assert sum("[secret]" in (r.text or "") for r in rows) == 30


def test_units_equal_the_library_in_any_order():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(3)
    pieces = ["word", "word,", "word.", "Ünï", ",", ".", "\n", "a\nb", "\t", " ", "<|endoftext|>", "don't", "12,5", "漢字。", "x.y,z", "it.\nThe", "é,"]
    texts = ["", None] + [" ".join(rng.choice(pieces) for _ in range(rng.randint(1, 40))) for _ in range(300)]
    tokens = units.TokenIds(path, True)
    for part in (texts[:150], texts[150:], texts):
        ids, n = tokens.encode(part)
        assert [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in part]


def test_shards_are_read_back_whatever_the_symbols():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 1 << 18), (7, 1 << 16), (8, 1 << 17), (1_001, 1 << 19)):
        symbols = rng.integers(0, top, n).astype(np.uint32)
        planes, packed = grammar.pack_symbols(symbols)
        assert (grammar.unpack_symbols(packed, planes) == symbols).all()
    for _ in range(100):
        ids = rng.choice([1, 2, 3, 9], rng.integers(1, 500)).astype(np.int32)
        lens = np.diff(np.r_[0, np.sort(rng.choice(len(ids) + 1, 3)), len(ids)])
        rules, symbols = grammar.compress(ids, lens, 10, least=4)
        assert (grammar.expand(symbols, rules, 10) == ids).all() and (grammar.unfold(symbols, rules, 10) == ids).all()
        inside = np.cumsum(grammar.lengths_of(symbols, grammar.expansion_lengths(rules, 10), 10))
        assert set(np.cumsum(lens[lens > 0]).tolist()) <= set(inside.tolist())
