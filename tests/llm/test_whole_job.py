"""Cases in which an operator once did less than its whole job."""

import math
import re
import string
import time
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pulsegrid.llm import anisotropic, crf, interpolation, mixing, secret_scan, shared, shingle_join, url_rules
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def brute_kept(rows, size=5):
    """Ids kept by brute force: the smallest of each component of texts of Jaccard similarity 0.8 or more."""
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
        sets.append(frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or 5 * len(a & b) >= 4 * len(a | b) and a:
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[root(i)].append(doc_id)
    return {min(ids) for ids in least.values()}


def test_near_copies_in_the_pipeline_against_a_brute_force_join(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    names = [f"w{i}" for i in range(3000)]
    texts = []
    for length in (6, 9, 30, 64, 65, 130, 300, 900):
        for _ in range(4):
            base = rng.choice(names, length).tolist()
            for changed in (0, 0.005, 0.01, 0.02, 0.023, 0.03, 0.05):
                texts.append(" ".join(str(rng.choice(names)) if rng.random() < changed else w for w in base))
            texts += [" ".join(base[: int(length * 0.82)]), " ".join(base[: int(length * 0.79)]), " ".join(base).upper()]
    passage = " ".join(rng.choice(names, 40).tolist())  # met in many texts that are no copies
    texts += [passage + " " + " ".join(rng.choice(names, int(n)).tolist()) for n in rng.integers(3, 60, 80)]
    texts += [None, "", " \n", "one two", "One  two"]
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(texts)), texts, strict=True)]
    docs, want = spark.createDataFrame(rows, "doc_id long, text string"), brute_kept(rows)
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    # groups that are dealt in blocks
    assert {r["component_id"] for r in shingle_join.near_duplicates(docs, limit=5).collect()} == want


def test_nearest_in_a_large_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(6000, 32))
    copies = np.arange(6000) % 3 == 1
    x[copies] = x[1] + 0.002 * np.linalg.norm(x[1]) / np.sqrt(32) * rng.normal(size=(copies.sum(), 32))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").coalesce(1)
    got = defaultdict(list)
    for r in anisotropic.nearest(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert len(got) == 60
    for q, found in got.items():
        assert found == [int(i) for i in np.lexsort((np.arange(6000), -(x * x[q]).sum(axis=1))) if i != q][:20]


def test_random_strings_are_caught_in_every_alphabet():
    rng = np.random.default_rng(10)
    vocabulary = secret_scan.encoding()
    lower, upper, digits = string.ascii_lowercase, string.ascii_uppercase, string.digits
    for alphabet in (lower + digits, upper + "234567", lower + upper, lower + upper + digits + "-_"):
        for length in (20, 24, 32, 40):
            runs = ["".join(rng.choice(list(alphabet), length)) for _ in range(500)]
            mixed = [r for r in runs if sum(bool(c.search(r)) for c in secret_scan.CLASSES) >= 2]
            assert sum(secret_scan.is_random(r, vocabulary) for r in mixed) >= 0.98 * len(mixed), (alphabet, length)
    for name in ("some_long_identifier_name_2024", "getHTTPResponseCodeFromServer2", "user-id-2024-11-26-17-58", "com/example/foo2/bar/BazQuxImpl"):
        assert not secret_scan.is_random(name, vocabulary)
    began = time.time()
    for run in ("1" + "a" * 100_000 + "A", "A" * 100_000 + "1b", "1a" * 50_000, "so l" + "o" * 100_000 + "ngB", "aB" * 50_000, "A" * 100_000 + "1b="):
        secret_scan.redacted(run)
    assert time.time() - began < 3


def test_texts_without_blanks_are_read_whole():
    texts = {"en": ["the of and that with from this " * 30] * 6, "fr": ["le la des avec dans pour une " * 30] * 6}
    model = crf.fit(texts)
    joined = "".join(texts["fr"][0].split()) * 20
    names, scores, sure = model.predict([joined, "the" * 10 + joined, texts["en"][0] + joined, "x" * 41, None])
    assert names[:2] == ["fr", "fr"] and scores[0] > 0.9 and names[4] == "und"
    parts = crf.links(joined)
    assert len(parts) > len(joined) / crf.LONGEST - 1
    # every n-gram of the run is one of some link's, and none is that is not
    grams = lambda w: {w[i : i + k] for k in (1, 2, 3) for i in range(len(w) - k + 1)}
    assert set().union(*(grams(p.strip(crf.CUT)) for p in parts)) == grams(joined)
    assert crf.links("a " + "b" * 40 + " " + "-" * 50 + "c") == ["a", "b" * 40, "-" * 50 + "c"]
    half = model.predict([texts["en"][0] + texts["fr"][0]])
    assert half[1][0] < 0.6 < 0.9 < half[2][0]  # a text in two languages is as sure as its words are


def test_interpolation_against_a_plain_model(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    crc = {i: zlib.crc32(str(i).encode()) for i, _ in rows}
    tokens = {i: ["<", *re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (t or "").encode())), ">"] for i, t in rows}
    train = [i for i, _ in rows if crc[i] % 7 != 2]
    held = [i for i in train if crc[i] // 7 % interpolation.EM_FOLD == 0]

    def counts(ids):
        word, pair = Counter(w for i in ids for w in tokens[i]), Counter(p for i in ids for p in zip(tokens[i], tokens[i][1:]))
        return word, pair, sum(n for w, n in word.items() if w != "<")

    def parts(model, v, w):
        word, pair, n = model
        return interpolation.bucket(np.array([word[v]]))[0], pair[v, w] / word[v] if word[v] else 0.0, word[w] / max(n, 1)

    whole, deleted = counts(train), counts([i for i in train if i not in set(held)])
    size = len([w for w in whole[0] if w != "<"])
    cells = Counter()
    step = lambda p: round(interpolation.STEPS * math.log2(p * (size + 1))) if p else None
    for i in held:
        for v, w in zip(tokens[i], tokens[i][1:]):
            b, p2, p1 = parts(deleted, v, w)
            cells[b, step(p2), step(p1)] += 1
    back = lambda x: 0.0 if x is None else 2 ** (x / interpolation.STEPS)
    weights = interpolation.em(np.array([(b, back(x), back(y), n) for (b, x, y), n in cells.items()], dtype=float), 66)
    got = {r["doc_id"]: r["score"] for r in interpolation.score(spark.read.parquet(f"{DATA}/documents.parquet"), chunk_tokens=5000).collect()}
    for i, _ in rows:
        want = 0.0
        for v, w in zip(tokens[i], tokens[i][1:]):
            b, p2, p1 = parts(whole, v, w)
            want += math.log10(weights[b] @ [p2, p1, 1 / (size + 1)])
        assert abs(got[i] - want) < 1e-6 * abs(want)


def plain_verdicts(labelled, asked, min_support=0.002, min_confidence=0.7, min_lift=1.1):
    """The verdicts that the surest mined rules allow for, by all sets of tokens."""
    n = len(labelled)
    least = max(url_rules.LEAST_ROWS, math.ceil(min_support * n))
    often = Counter(t for tokens, _ in labelled for t in tokens)
    sets, then = Counter(), Counter()
    for tokens, verdict in labelled:
        known = sorted(t for t in tokens if often[t] >= least)
        for k in range(1, len(known) + 1):
            for some in combinations(known, k):
                sets[some] += 1
                then[some, verdict] += 1
    share = Counter(v for _, v in labelled)
    rules = {key: c / sets[key[0]] for key, c in then.items() if c >= least and c / sets[key[0]] >= max(min_confidence, min_lift * share[key[1]] / n)}
    kept = {(s, v): c for (s, v), c in rules.items() if not any(rules.get((part, v), -1) >= c for k in range(1, len(s)) for part in combinations(s, k))}
    out = []
    for tokens in asked:
        fits = [(c, then[s, v], v) for (s, v), c in kept.items() if set(s) <= set(tokens)]
        out.append({v for c, m, v in fits if (c, m) == max((c, m) for c, m, _ in fits)} if fits else {"allow"})
    return out


def test_mined_verdicts_against_all_sets_of_tokens(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url")
    rows = url_rules.parts(pages).withColumns({"fixed": url_rules.fixed(url_rules.RULES, "verdict"), "tokens": url_rules.tokens()}).collect()
    asked = [r for r in rows if r["fixed"] is None]
    want = plain_verdicts([(r["tokens"], r["fixed"]) for r in rows if r["fixed"]], [r["tokens"] for r in asked])
    for got in (url_rules.judge(pages).collect(), url_rules.judge(pages, broadcast_tokens=0).collect()):
        verdict = {r["page_id"]: r["verdict"] for r in got}
        assert all(verdict[r["page_id"]] in w for r, w in zip(asked, want, strict=True))
        assert len(got) == len(rows) and any(r["mined"] for r in got)


def test_tokens_that_go_together_do_not_multiply(spark):
    many = [(i, f"http://bad.net/es/{'/'.join(f'x{c}' for c in string.ascii_lowercase)}?{'&'.join(f'q{c}=1' for c in string.ascii_lowercase)}") for i in range(40)]
    rows = many + [(100 + i, f"http://good{i}.com/{'/'.join(rng)}") for i, rng in enumerate([["a", "b"], ["a"], ["b"]] * 20)] + [(900, "http://new.org/xa/xb?qa=1"), (901, "http://new.org/" + "y/" * 5000)]
    began = time.time()
    got = {r["page_id"]: r for r in url_rules.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[900]["verdict"] == "block" and got[901]["verdict"] == "allow" and time.time() - began < 120


def test_a_plan_against_its_quotas(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.plan(docs, 0.95, 4.0, block_tokens=50_000).toPandas()
    first = rows[rows["copy"] == 0]
    totals = first.groupby("source")["tokens"].sum()
    shares = (totals / totals.sum()).to_numpy()
    low, high = 0.0, 1.0
    for _ in range(60):  # the largest exponent with the wanted entropy
        mid = (low + high) / 2
        w = shares**mid / (shares**mid).sum()
        low, high = (mid, high) if -(w * np.log(w)).sum() >= 0.95 * math.log(len(w)) else (low, mid)
    w = shares**low / (shares**low).sum()
    assert (w / shares).max() / (w / shares).min() <= 4.0
    quota = dict(zip(totals.index, w * (totals.to_numpy() / w).max(), strict=True))
    blocks = rows["block"].nunique()
    for source, part in rows.groupby("source"):
        longest = part["tokens"].max()
        assert quota[source] * 0.999 <= part["tokens"].sum() <= quota[source] * 1.001 + longest
        assert set(part["doc_id"]) == set(docs.where(F.col("source") == source).toPandas()["doc_id"])
        copies = part.groupby("doc_id")["copy"].agg(["size", "max"])
        assert (copies["size"] == copies["max"] + 1).all() and copies["max"].max() - copies["max"].min() <= 1
        assert (part.groupby("block")["tokens"].sum() - quota[source] / blocks).abs().max() <= 2 * longest
    assert all(sorted(g) == list(range(1, len(g) + 1)) for _, g in rows.groupby("block")["place"])


def test_one_id_of_very_many_rows(spark):
    rows = [(None if i % 3 else 7, f"text {i} " * (1 + i % 5), "a" if i % 4 else None) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.plan(docs, None, None, block_tokens=5000)
    assert got.count() == 6000 and got.select("block", "place").distinct().count() == 6000
    assert mixing.mixed(docs).count() >= 6000


def test_an_exponent_of_very_many_sources(spark):
    rng = np.random.default_rng(3)
    totals = (rng.pareto(1.2, 3000) * 50 + 1).astype(int).tolist()
    shares, times = mixing.shares_of(spark.createDataFrame([(str(i), n) for i, n in enumerate(totals)], "source string, total long"))
    exact = mixing.exponent([n / sum(totals) for n in totals], 0.95, None)
    assert sum(times) == 3000 and len(shares) < 1500 and abs(mixing.exponent(shares, 0.95, None, times) - exact) < 1e-3


def test_ids_with_several_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 9))
    ids = [i // 2 for i in range(300)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    for bytes_ in (64 << 20, 800):  # one block of queries, and many
        quantiser = anisotropic.fit(anisotropic.usable(table))
        got = defaultdict(list)
        for r in anisotropic.search(anisotropic.index(anisotropic.usable(table), quantiser), quantiser, F.col("vec_id") % 20 == 0, 7, query_bytes=bytes_).orderBy("query_id", "rank").collect():
            got[r["query_id"]].append(r["vec_id"])
        assert set(got) == set(range(0, 150, 20))
        for q, found in got.items():
            s = (x * min(x[2 * q].tolist(), x[2 * q + 1].tolist())).sum(axis=1)
            assert found == [ids[i] for i in np.lexsort((ids, -s)) if ids[i] != q][:7]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default: None)

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session)


def test_secrets_of_a_long_dump_in_linear_time():
    rng = np.random.default_rng(11)
    letters = np.array(list(string.ascii_letters + string.digits))
    line = lambda: "password=abcdef1 " + "".join(rng.choice(letters, 24)) + "\n"
    text = "".join(line() for _ in range(1000)) * 97
    assert len(text) > 4_000_000
    secret_scan.encoding()
    began = time.time()
    base = secret_scan.base_spans(text)
    more = secret_scan.random_spans(text, base)
    assert time.time() - began < 15 and len(base) == 97_000 and len(more) > 90_000
    out = secret_scan.redacted(text[:420_000])
    assert out.count("[SECRET]") > 19_000 and "password" not in out


def test_random_runs_beside_spans_that_overlap():
    """Against comparing every run with every span."""
    rng = np.random.default_rng(12)
    vocabulary = secret_scan.encoding()
    pieces = ["password=aaaaaaa", "AKIA" + "Q7" * 10, "0123456789abcdef" * 2, "k9XvB2qLm4ZpT7wRj3Hs8NcD", " ", "\n", "token: ", "x"]
    for _ in range(300):
        text = "".join(rng.choice(pieces, int(rng.integers(1, 12))))
        base = secret_scan.base_spans(text)
        want = [(m.start(), 3, m.end()) for m in secret_scan.RUN.finditer(text) if not any(s < m.end() and m.start() < e for s, _, e in base) and secret_scan.is_random(m.group(), vocabulary)]
        assert secret_scan.random_spans(text, base) == want


def test_nearest_of_each_length(spark):
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(size=(8, 3, 5)[i % 3]).tolist()) for i in range(150)] + [(200, [0.0, 0.0]), (201, None), (202, [1.0]), (203, [])]
    got = anisotropic.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 2 == 0, k=4).collect()
    found, of = defaultdict(list), dict(rows)
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found[r["query_id"]].append(r["vec_id"])
    for q in range(0, 150, 2):
        own = [i for i in range(150) if i % 3 == q % 3 and i != q]
        assert found[q] == sorted(own, key=lambda i: (-float(np.dot(of[i], of[q])), i))[:4]
    assert set(found) == set(range(0, 150, 2))


def test_sample_of_a_language_is_bounded_in_characters(spark):
    rows = [(i, "the of and to in " * (40 if i % 10 else 4000), "en") for i in range(60)] + [(i, "le la des avec " * 30, "fr") for i in range(60, 120)] + [(i, "der die das " * 9000, "de") for i in range(120, 123)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = crf.learn(docs, F.lit(True), characters=60_000)
    got = {r["doc_id"]: r["lang_pred"] for r in crf.identify(docs, model).collect()}
    assert all(got[i] == lang for i, _, lang in rows)


@pytest.fixture(scope="module")
def very_long(spark):
    """One text of 300,000 words among plain ones."""
    rng = np.random.default_rng(14)
    words = "the of and to in that with from which water house under light paper".split()
    rows = [(i, " ".join(rng.choice(words, 60)) + ".", "en", "a", 0) for i in range(40)]
    rows.append((99, "\n".join(" ".join(rng.choice(words, 30)) for _ in range(10_000)), "en", "b", 0))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), dict((r[0], r[1]) for r in rows)


def test_very_long_texts(spark, very_long):
    from pulsegrid.llm import kneser_ney, rule_ensemble, simhash

    docs, texts = very_long
    of = lambda df: {r["doc_id"]: r for r in df.collect()}[99]
    assert of(interpolation.score(docs))["n_tokens"] == 300_001
    judged = of(kneser_ney.judge(docs))
    assert judged["n_words"] == 300_000 and judged["word_chars"] == sum(map(len, texts[99].split())) and not math.isnan(judged["perplexity"])
    found = of(simhash.near_duplicates(docs))
    assert found["component_id"] == 99 and found["fingerprint"] == f"{int(simhash.of_hashes(shingle_join.hashes(texts[99], 3))):016x}"
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    assert 0 <= of(rule_ensemble.score(docs, rule_ensemble.learn(docs, labels, F.lit(True))))["score"] <= 1
    assert {r["component_id"] for r in shingle_join.near_duplicates(docs).collect()} >= {99}


def test_stages_of_no_documents(spark):
    import corpus_pipeline

    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "").count() == 0, name
    model = crf.learn(none, F.lit(True))
    assert crf.accepted(none, model).count() == 0


def test_kept_by_perplexity_bands_computed_anew(spark):
    """The base rules and the bands, from the perplexities, by plain Python."""
    from pulsegrid.llm import kneser_ney

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r for r in kneser_ney.judge(docs).collect()}
    measured = [r.asDict() for r in kneser_ney.measured(docs).collect()]
    middle_of = lambda x: sorted(x)[math.ceil(len(x) / 2) - 1]
    sound = defaultdict(list)
    for r in measured:
        if not (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]):
            sound[r["model"] // 2].append(r)
    bands = {}
    for lang, rows in sound.items():
        middle, typical = middle_of([r["log_perplexity"] for r in rows]), middle_of([r["symbols"] for r in rows])
        longer = lambda r, typical=typical: max(1.0, math.sqrt(typical / r["symbols"]))
        bands[lang] = middle, longer, middle_of([abs(r["log_perplexity"] - middle) / longer(r) for r in rows]), len(rows)
    common = sum(b[2] * b[3] for b in bands.values()) / sum(b[3] for b in bands.values())
    kept = {}
    for r in measured:
        kept[r["doc_id"]] = False
        if r in sound[r["model"] // 2]:
            middle, longer, spread, n = bands[r["model"] // 2]
            width = 1.4826 * (spread + common * kneser_ney.FEW / n) * longer(r)
            kept[r["doc_id"]] = middle - kneser_ney.BELOW * width <= r["log_perplexity"] <= middle + kneser_ney.ABOVE * width
    assert {i: r["kept"] for i, r in got.items()} == kept and 0 < sum(kept.values()) < len(kept)
