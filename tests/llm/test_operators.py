import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from helpers import AWKWARD, awkward, labels

pytest.importorskip("filegraph.llm")
from pyspark.sql import functions as F  # noqa: E402

from filegraph.llm import bpe, langid, minhash, mixing, pii, quality, rules, spotsigs, token_counts, toxicity  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def good(kind, m):
        d = re.sub("[^0-9]", "", m)
        if kind == "card":
            return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p or 0) <= 255 for p in m.split(".")) if kind == "ip" else True, "phone": 9 <= len(d) <= 15}[kind]

    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text or "") if good(k, m.group())]


TRICKY = "é a@b.c_d@e.f x@y.zz. 1.2.3.4.5.6.7.8 0255.0.0.1 256.1.1.1 4111 1111 1111 1111 +1 (523) 555-1055) ++44 20 7946 0958-- 😀 a@b.co.uk " + "9" * 3000 + " " + "1 " * 2000


def test_pii_base_equals_plain_patterns(spark, docs, texts):
    df = docs.select("doc_id", "text").union(spark.createDataFrame([(-1, TRICKY)], "doc_id long, text string"))
    got = {r["doc_id"]: (r["base_sha256"], r["n_email"] + r["n_ip"] + r["n_card"] + r["n_phone"]) for r in pii.report(df).collect()}
    for i, t in {**texts, -1: TRICKY}.items():
        want = base_spans(t)
        assert got[i] == (hashlib.sha256(",".join(want).encode()).hexdigest(), len(want))


def test_pii_bootstraps_and_masks(spark):
    rows = [(i, f"my phone number +1 (523) 555-{1000 + i} ok") for i in range(6)] + [(30, "my phone number 5551234 and then"), (31, "a plain 5551234 elsewhere")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["spans"] for r in pii.report(df).collect()}
    assert got[30] == "phone:16:23" and got[31] == ""
    assert {r["doc_id"]: r["text"] for r in pii.mask(df).collect()}[30] == "my phone number [PHONE] and then"


def plain_bootstrap(texts):
    """Spans of all texts by the stated rules, over plain lists."""
    token = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]*[0-9][A-Za-z0-9]*(?:[-./_][A-Za-z0-9]+)*")
    slots, totals, where = Counter(), Counter(), defaultdict(list)
    for i, t in texts.items():
        words = re.split(r"\s+", t.lower())
        totals.update(map(" ".join, zip(words, words[1:])))
        taken = [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in base_spans(t))]
        free = [("token", m.start(), m.end()) for m in token.finditer(t) if sum(c.isdigit() for c in m.group()) >= 4 and not any(s < m.end() and m.start() < e for _, s, e in taken)]
        for k, s, e in taken + free:
            if left := re.search(r"(\S+)\s+(\S+)\s*$", t[:s].lower()):
                slots[" ".join(left.groups()), t[s:e].lower(), k] += 1
                if k == "token":
                    where[i].append((" ".join(left.groups()), s, e))
    known, sure = {(v, k): 1.0 for _, v, k in slots if k != "token"}, {}
    induced = {x for x, _, k in slots if k != "token"}
    for turn in range(2):
        got = defaultdict(list)
        for (x, v, _), n in slots.items():
            for k in BASE:
                if (v, k) in known and x in induced:
                    got[x, k].append(n * known[v, k])
        sure = {x: min(1.0, sum(s) / totals[x[0]]) for x, s in got.items() if len(s) >= 3 and sum(s) / totals[x[0]] >= 0.5}
        if turn == 0:
            miss = defaultdict(lambda: 1.0)
            for x, v, k in slots:
                for c in BASE:
                    if k == "token" and (x, c) in sure:
                        miss[v, c] *= 1 - sure[x, c]
            for x, m in miss.items():
                known[x] = max(known.get(x, 0.0), 1 - max(m, 1e-9))
    out = {}
    for i, t in texts.items():
        spans = [(list(BASE).index(k), int(s), int(e)) for k, s, e in (x.split(":") for x in base_spans(t))]
        for x, s, e in where[i]:
            fits = [(-sure[x, k], list(BASE).index(k)) for k in BASE if (x, k) in sure]
            spans += [(min(fits)[1], s, e)] if fits else []
        out[i] = ",".join(f"{list(BASE)[k]}:{s}:{e}" for k, s, e in sorted(spans))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_pii_bootstrap_equals_plain_version(spark, monkeypatch, seed):
    rng = random.Random(seed)
    monkeypatch.setattr(pii, "IN_PLAN", 2_000 * (seed - 1))  # with seed 1 patterns are joined with all pairs of words
    phones, mails, ids = [f"+1 (523) 555-{1000 + i}" for i in range(9)], [f"a{i}@b{i}.com" for i in range(9)], [f"id{i}-{4000 + i}" for i in range(9)]
    slots = {"call me": phones * 2 + ids, "write to": mails * 2 + ids[:5] + ["word"], "id no": ids * 3 + phones[:1], "of the": ["word"] * 40 + phones + ids}
    texts = {i: " ".join(f"{x} {rng.choice(slots[x])} then" for x in rng.choices(list(slots), k=rng.randint(0, 6))) for i in range(150)}
    got = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == plain_bootstrap(texts)
    assert any(got[i] != ",".join(base_spans(t)) for i, t in texts.items())


def components(texts):
    sets = {}
    for i, t in texts.items():
        w = t.encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    shared, holders, up = Counter(), defaultdict(list), {i: i for i in texts}
    for i, s in sets.items():
        for g in s:
            shared.update((j, i) for j in holders[g])
            holders[g].append(i)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in shared.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: (len(sets[i]), root(i)) for i in texts}


def test_near_duplicates_equal_brute_force(docs, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == components(texts)


def test_crowded_near_copies_equal_brute_force(spark):
    """Copies of one text with few to many edits: links reach past the original, and many pairs lie just below the threshold."""
    draw = random.Random(5)
    first, texts = [f"w{i}" for i in range(150)], {}
    for i in range(400):
        words = first[: draw.choice((150, 150, 120))]
        for _ in range(draw.randint(0, 9)):
            words[draw.randrange(len(words))] = f"e{draw.randrange(60)}"
        texts[i] = " ".join(words)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == components(texts)


def test_mixing_reaches_its_targets(docs):
    out = mixing.mix(docs, carry=True).select("size", "taken", "target", "source_size", F.col("__own.source").alias("source")).collect()
    by = defaultdict(lambda: [0, 0, 0.0])
    for r in out:
        assert r["taken"] <= 3 * r["size"]
        by[r["source"]][0] += r["size"]
        by[r["source"]][1] += r["taken"]
        by[r["source"]][2] = r["target"]
    total, weight = sum(v[0] for v in by.values()), {s: i % 3 + 1 for i, s in enumerate(sorted(by, key=str.encode))}
    capped = set()
    while True:
        free = [s for s in by if s not in capped]
        level = (total - sum(3 * by[s][0] for s in capped)) / sum(weight[s] for s in free)
        new = {s for s in free if weight[s] * level > 3 * by[s][0]}
        if not new:
            break
        capped |= new
    for s, (size, taken, target) in by.items():
        assert target == pytest.approx(3 * size if s in capped else weight[s] * level) and abs(taken - target) <= 1


def test_bpe_equals_library(spark):
    tiktoken, public = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    coder = bpe.Coder(public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN)
    lib = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=coder.ranks, special_tokens={})
    r, letters = random.Random(1), "ab' sreLl\n\t  é1½!=\x1c\x85中😀"
    given = [None, "", " ", "x" * 3000, "= " * 50 + "=" * 900, *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(500))]
    for t, (n, ids, back) in zip(given, coder.encode(given), strict=True):
        assert ids == ",".join(map(str, want := lib.encode_ordinary(t or ""))) and n == len(want) and back == (t or "")


def test_prefix_counts_equal_library():
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    own, lib = token_counts.Counter(public.path("byte_bpe_50k.json"), public.PATTERN), tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    n = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    r, letters = random.Random(2), "ab' sreLl\n\t  é1½!=\x1c\x85中😀"
    for t in ["", "a<|endoftext|> b", "x" * 2000, *("".join(r.choice(letters) for _ in range(r.randrange(40))) for _ in range(300))]:
        assert own.count(t) == n(t)
        if len(t) < 100:
            assert own.prefixes(t).tolist() == [n(t[:i]) for i in range(len(t) + 1)]
    assert n(own.truncate("hello world " * 400, 512)) <= 512
    for t in ("hello world " * 40, "one<|endoftext|>two three four", "", None):
        for budget, cut in zip((1, 3, 50), own.cuts(t, [1, 3, 50]), strict=True):
            assert n((t or "")[:cut]) <= budget and all(n(t[:k]) > budget for k in range(cut + 1, len(t or "") + 1))


def test_spotsigs_edits(docs, texts):
    out, ids = {r["doc_id"]: r for r in spotsigs.report(docs).collect()}, sorted(texts)
    for a, b in zip(ids, [*ids[1:], ids[0]], strict=True):
        changed = spotsigs.edited(texts[a], texts[b])
        assert out[a]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and out[a]["n_chars"] == len(texts[a])
        assert out[a]["fingerprint"] == spotsigs.fingerprint(spotsigs.signatures(texts[a]))
        assert out[a]["near_next"] == spotsigs.likeness(spotsigs.signatures(texts[a]), spotsigs.signatures(texts[b]))
    assert sum(r["near_edited"] > r["near_next"] for r in out.values()) > 0.9 * len(out)


def test_spotsigs_ranges_change_nothing(docs, monkeypatch):
    whole = sorted(map(tuple, spotsigs.report(docs).collect()))
    monkeypatch.setattr(spotsigs, "RANGE_ROWS", 17)
    assert sorted(map(tuple, spotsigs.report(docs).collect())) == whole


def test_spotsigs_follow_their_rule(texts):
    """Signatures of a plain walk over the words: an anchor, or a word after GAP words without one, and the CHAIN content words after it."""
    for t in [*list(texts.values())[:60], "the cat", "", "a b c d e f g h i j", "der Hund, und die Katze"]:
        core = [w.lower().strip("!?.,;:\"'()[]{}#*$%&|<>-_=+~^/\\") or w for w in (t or "").split()]
        anchors, last, chains = [w in spotsigs.ANCHORS for w in core], -1, set()
        content = [w for w, a in zip(core, anchors, strict=True) if not a]
        for i, w in enumerate(core):
            last = i if anchors[i] else last
            if i - last > spotsigs.GAP or anchors[i]:
                after = [x for x, a in zip(core[i + 1 :], anchors[i + 1 :], strict=True) if not a][: spotsigs.CHAIN]
                if len(after) == spotsigs.CHAIN:
                    chains.add((w, *after))
        if len(core) < spotsigs.SHORT or len(content) < spotsigs.CHAIN + 1:
            chains |= {(w,) for w in core}
        assert len(spotsigs.signatures(t)) == len(chains)


def test_word_vectors_equal_plain_sums(docs):
    index, want = quality.index_vectors().astype(int), __import__("numpy").zeros((quality.BUCKETS, quality.DIM))
    for r in docs.collect():
        rows = quality.rows_of(quality.coded(r["text"]))
        for i, x in enumerate(rows):
            want[x] += index[rows[max(0, i - quality.WINDOW) : i]].sum(axis=0) + index[rows[i + 1 : i + 1 + quality.WINDOW]].sum(axis=0)
    norm = __import__("numpy").linalg.norm(want, axis=1, keepdims=True).clip(1)
    assert abs(quality.word_vectors(docs) - (want / norm + index[:-1] / quality.NONZERO**0.5)).max() < 1e-5


def test_languages_equal_plain_profiles(docs):
    """Rank-order profiles and out-of-place distances, over plain counters."""
    profiles, n = langid.fit(docs), langid.PROFILE

    def grams(t):
        words = "".join(c if c.isalpha() else " " for c in (t or "").lower()).split()
        return Counter(g for w in words for p in [f" {w} "] for k in (1, 2, 3) for g in (p[i : i + k] for i in range(len(p) - k + 1)) if g != " ")

    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    ranks = {k: {int(c): i for i, c in enumerate(v)} for k, v in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.report(docs).collect()}
    for r in docs.filter("length(text) < 3000").collect():
        own = sorted(((-c, code(g)) for g, c in grams(r["text"]).items()))[:n]
        if not own:
            assert got[r["doc_id"]][0] == "und"
            continue
        far = {k: sum(abs(known[c] - i) if c in known else n for i, (_, c) in enumerate(own)) / (n * len(own)) for k, known in ranks.items()}
        best = min(far, key=lambda k: (far[k], k))
        assert got[r["doc_id"]][0] == best and abs(got[r["doc_id"]][1] - (1 - far[best])) < 1e-9


def test_concentration_equals_plain_steps(spark):
    """The estimate of one group against numpy, from the same start and with the same steps."""
    np = __import__("numpy")
    x = np.random.default_rng(4).normal(size=(400, rules.P)) * 0.3
    x[:40] += 5
    df = spark.createDataFrame([("a", r.tolist()) for r in x], "g string, x array<double>")
    got = rules.estimate(df).first()
    mean = np.sort(x, axis=0)[199]
    spread = np.sort(abs(x - mean), axis=0)[199]
    inverse = np.diag(1 / ((1.4826 * spread) ** 2 + np.square(rules.FLOOR)))
    floor = np.diag(np.square(rules.FLOOR))
    far = lambda m, v: np.einsum("ij,jk,ik->i", x - m, v, x - m)
    w = rules.P / (rules.P + far(mean, inverse))
    other = (w[:, None] * x).sum(0) / w.sum()
    starts = [(mean, inverse), (other, np.linalg.inv(((x - other).T * w) @ (x - other) / w.sum() + floor))]
    ends = []
    for m, v in starts:
        was, size = np.inf, 1e9
        while was - size > rules.TOLERANCE:
            d = far(m, v)
            near = x[d <= np.sort(d)[int(np.ceil(rules.SUBSET * 400)) - 1]]
            m, cov = near.mean(axis=0), np.cov(near.T, bias=True) + floor
            v, was, size = np.linalg.inv(cov), size, np.linalg.slogdet(cov)[1]
        ends.append((size, m.tolist(), v))
    size, mean, inverse = min(ends, key=lambda e: e[:2])
    assert abs(np.array(got["mean"]) - mean).max() < 0.02 and abs(np.array(got["mean"])).max() < 0.2
    assert abs(-np.linalg.slogdet(np.array(got["inverse"]).reshape(rules.P, rules.P))[1] - size) < 0.05
    d = far(np.array(mean), inverse)
    assert d[:40].min() * rules.CHI_SUBSET / max(got["cut"], rules.CHI_SUBSET) > rules.CUT


def test_toxicity_risk_is_corrected(spark):
    """Toxic words are learned though the unlabelled texts hold toxic ones too."""
    draw = random.Random(3)
    plain = lambda: " ".join(draw.choice("alpha beta gamma delta omega sigma".split()) for _ in range(30))
    toxic = lambda: plain() + " vile filth vile scum"
    rows = [(i, toxic() if i % 5 == 0 else plain()) for i in range(600)]
    marks = [(i, int(i % 5 == 0)) for i, _ in rows if i % 2]
    out = toxicity.report(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 5 == 0) == bool(r["predicted"]) for r in out)


def test_rules_counts():
    assert rules.statistics("a b c d e f\na b c d e f\n\na b c d e f #$")[0] == (19, 20, 2, 1, 18)
    assert rules.statistics(None)[0] == (0, 0, 0, 0, 0)


def test_held_out_accuracy(spark):
    big = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{big}/documents.parquet"), spark.read.parquet(f"{big}/labels.parquet")
    lang = langid.report(docs).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    assert lang.filter("lang_pred = lang").count() >= 0.98 * lang.count()
    q = quality.report(docs, marks).filter("held_out").join(marks, "doc_id")
    assert q.filter("predicted = quality").count() >= 0.95 * q.count()
    kept = rules.report(docs).filter("NOT base_failed").join(marks, "doc_id")
    assert kept.filter("quality = 1 AND kept").count() >= 0.97 * kept.filter("quality = 1").count()
    assert kept.filter("quality = 0 AND kept").count() <= 0.2 * kept.filter("quality = 0").count()


def _files():
    import public_tokenizers as public

    return public.path("byte_bpe_multi_50k.tiktoken"), public.path("byte_bpe_50k.json"), public.PATTERN


OPERATORS = {
    "bpe": lambda d: bpe.report(d, _files()[0], _files()[2]), "token_counts": lambda d: token_counts.report(d, *_files()[1:]), "budgets": lambda d: token_counts.budgets(d, *_files()[1:], [3, 512]),
    "pii": pii.report, "minhash": minhash.near_duplicates, "mixing": mixing.report, "langid": langid.report, "rules": rules.report, "spotsigs": spotsigs.report,
    "quality": lambda d: quality.report(d, labels(d.sparkSession)), "toxicity": lambda d: toxicity.report(d, labels(d.sparkSession)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    """One row out for each row in, whatever it holds; the same columns from an empty table."""
    out = OPERATORS[name](awkward(spark))
    assert Counter(r["doc_id"] for r in out.collect()) == Counter(r[0] for r in AWKWARD)
    none = OPERATORS[name](awkward(spark).limit(0))
    assert none.count() == 0 and none.columns == out.columns


def test_awkward_results(spark):
    near = {r["doc_id"]: r for r in minhash.near_duplicates(awkward(spark)).collect()}
    assert near[None]["component_id"] is None and near[None]["kept"] and near[3]["n_shingles"] == 0 and near[6]["n_shingles"] == 1
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.report(awkward(spark)).collect()}
    assert {lang[i] for i in (2, 3, 5, 8)} == {"und"}
