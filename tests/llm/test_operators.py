"""Operators against brute force, SQL, exact round trips or held-out rows, and their edge cases."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from panelwise.llm import chat, decontaminate, exact, html, licenses, mixing, pii, queries, tokens, toxicity
from tests.compare import compare, oracle

DOCS = "doc_id bigint, text string, source string, row string, salt int, size string, key string"
LONG = "long word " * 40_000
EDGES = [
    (1, "a b c", "x", "r", 1, "s", "k"),
    (1, "a b c", "x", "r", 1, "s", "k"),
    (2, None, None, None, None, None, None),
    (None, "", "x", "r", 1, "s", "k"),
    (3, "abc", "y", "", 0, "", ""),
    (4, LONG, "y", "", 0, "", ""),
    (5, " a\tb\nc ", "é", "", 0, "", ""),
]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, DOCS)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def texts(sf):
    rows = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    return {r["doc_id"]: r["text"] for r in rows}


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_equal_to_sql(spark, sf, name):
    assert compare(oracle(sf), queries.QUERIES[name](spark, sf), queries.ORACLE[name]) is None


def test_exact_edges(edges, nothing):
    got = sorted(map(tuple, exact.exact_groups(edges).collect()), key=repr)
    same = hashlib.sha256(b"abc").hexdigest()
    abc = [r for r in got if r[4] == same]
    # " a\tb\nc " has the most code points; of the rows for empty texts the one with an id stays
    assert len(abc) == 4 and all(r[1:3] == (5, 4) for r in abc) and [r[0] for r in abc if r[3]] == [5]
    assert [r[0] for r in got if r[2] == 2 and r[3]] == [2] and sum(r[3] for r in got) == 3
    assert exact.exact_groups(nothing).count() == 0


def test_chunk_identifiers_are_verified(spark):
    words = [f"{i:05d}" * 400 for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(words + words)), "doc_id bigint, text string")
    weak = lambda chunk, attempt: bytes([len(chunk) % 2]) if attempt < 2 else exact.identifier(chunk, attempt)
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact.exact_groups(docs, weak).collect()}
    assert got == {i: (i % 12, 2) for i in range(24)}


def test_chunks_do_not_depend_on_neighbours():
    import pyarrow as pa

    r = random.Random(1)
    text = "".join(r.choice("abcdefgh") for _ in range(30_000))
    raw, begins = exact.squeezed(pa.array(["xyz" * 50, text, text]))
    places = exact.cuts(raw)
    ends = np.searchsorted(places, begins)
    a, b = (exact.pieces(30_000, places[ends[i] : ends[i + 1]] - begins[i]) for i in (1, 2))
    assert a == b and len(a) > 5 and a[0][0] == 0 and a[-1][1] == 30_000 and all(x[1] == y[0] for x, y in zip(a, a[1:]))


def fill(sizes, epochs=3):
    """Targets by repeated sharing: what a full source cannot take is shared again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(epochs * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: epochs * sizes[s] if s in full else weight[s] * left / open_weight for s in names}
        more = {s for s in names if s not in full and target[s] >= epochs * sizes[s]}
        if not more:
            return target
        full |= more


def test_mix(spark, sf, edges, nothing):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "source").join(mixing.mix_report(docs), "doc_id").collect()
    sizes, taken, target = collections.Counter(), collections.Counter(), {}
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = fill(sizes)
    assert all(abs(target[s] - want[s]) < 1e-6 for s in want)
    largest = max(r.size for r in rows)
    assert all(abs(taken[s] - want[s]) <= largest for s in want)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert collections.Counter(r.doc_id for r in mixed.select("doc_id").collect()) == +collections.Counter({r.doc_id: r.taken // r.size if r.size else 0 for r in rows})
    report = mixing.mix_report(edges)
    assert report.count() == len(EDGES) and sorted(map(tuple, report.collect()), key=repr) == sorted(map(tuple, mixing.mix_report(edges).collect()), key=repr)
    assert mixing.mix(edges).columns == edges.columns and mixing.mix(nothing).count() == 0 and mixing.mix_report(nothing).count() == 0


@pytest.mark.parametrize("width", [1, 5, 8, 13, 16, 17, 31, 32])
def test_packing(width):
    r = np.random.default_rng(width)
    for n in (0, 1, 63, 64, 65, 1000):
        ids = r.integers(0, 1 << width, n, dtype=np.uint64).astype(np.uint32)
        packed = tokens.pack(ids, width)
        assert len(packed) == -(-n // 64) * width * 8
        assert (tokens.unpack(packed, width, 0, n) == ids).all()
        if n > 3:
            assert (tokens.unpack(packed, width, n // 3, n // 2) == ids[n // 3 : n // 3 + n // 2]).all()
    assert [tokens.bit_width(v) for v in (1, 2, 3, 50_257, 65_537)] == [1, 1, 2, 16, 17]


def test_token_store(spark, texts, sf, edges, nothing):
    plain = Tokenizer.from_file(queries.TOKENIZER)
    extra = {10**6: None, 10**6 + 1: "", 10**6 + 2: "two  blanks \n <|endoftext|> it's so", 10**6 + 3: " x " * 3000}
    given = {**texts, **extra}
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string").repartition(5)
    store = tokens.write_tokens(docs, queries.TOKENIZER)
    ids = {d: [*plain.encode(t or "", add_special_tokens=False).ids, 2] for d, t in given.items()}
    at, want = 0, []
    for d in sorted(given):
        want.append((d, at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes())))
        at += len(ids[d])
    assert sorted(map(tuple, tokens.read_documents(store).collect())) == want
    every = [i for d in sorted(given) for i in ids[d]]
    for a, n in ((0, 10), (len(every) // 2, 70_000), (len(every) - 5, 5)):
        assert tokens.read_range(store, a, n).tolist() == every[a : a + n]
    got = tokens.read_documents(tokens.write_tokens(edges, queries.TOKENIZER)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1, 2, 3, 4, 5] and got[0].n_tokens == 1
    assert tokens.read_documents(tokens.write_tokens(nothing, queries.TOKENIZER)).count() == 0


def test_encoder_equals_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_PIECES", 50)
    with open(queries.TOKENIZER, encoding="utf-8") as f:
        code = tokens.Encoder(f.read())
    r = random.Random(4)
    bits = ["a", "B", "é", " ", "  ", "\n", "\t", "'s", "'", "1", "²", ".", "###", "word", "<|endoftext|>", " ", "\x1c", "日本", "_", "́", "x" * 70]
    given = ["".join(r.choice(bits) for _ in range(r.randint(0, 25))) for _ in range(3000)]
    for i in range(0, len(given), 100):
        whole = code.tokenizer.encode_batch(given[i : i + 100], add_special_tokens=False)
        assert code.encode(given[i : i + 100]) == [np.array(e.ids, "<u4").tobytes() for e in whole]


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels, ["trash can"])
    rows = toxicity.score(docs, lexicon).where("held_out").join(labels, "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in rows)
    assert sum(r.predicted == r.toxic for r in rows) >= 0.9 * len(rows)
    score = {t: toxicity._score(lexicon.curve, *toxicity.matched(toxicity.fold(t), lexicon.automaton())) for t in ("", "idiot trash", "ІD10T TR4SH!", "a trash can", "x idiots")}
    assert score["ІD10T TR4SH!"] == score["idiot trash"] > 0.5 > score[""] == score["a trash can"]
    kept = toxicity.keep_clean(docs, lexicon)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, lexicon).where("predicted = 0").count()


def test_toxicity_edges(spark, edges, nothing):
    labels = spark.createDataFrame([(1, 1, "x"), (1, 0, "x"), (None, 1, None), (3, None, None)], "doc_id bigint, toxic int, text string")
    lexicon = toxicity.train(edges, labels)
    assert toxicity.score(edges, lexicon).count() == len(EDGES)
    untrained = toxicity.train(nothing, labels.where("1 = 0"))
    assert {r.predicted for r in toxicity.score(edges, untrained).collect()} == {0}
    assert toxicity.keep_clean(edges, untrained).count() == len(EDGES) and toxicity.keep_clean(nothing, untrained).count() == 0


def test_toxicity_exceptions_of_clean_texts_alone(spark):
    toxic = [f"you grobian{'' if i % 2 else 'e'} of words" for i in range(100)]
    clean = [f"the day of words {'grobschmied' if i % 10 == 0 else 'smith'}" for i in range(100)]
    docs = spark.createDataFrame(list(enumerate(toxic + clean)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in range(200)], "doc_id bigint, toxic int")
    lexicon = toxicity.train(docs, labels)
    assert any(" grobschmied".startswith(e) for e, _ in lexicon.weights) and lexicon.exceptions == ("grobschmied",)
    assert toxicity.matched(toxicity.fold("a grobschmied"), lexicon.automaton()) == (0.0, 2)
    assert toxicity.matched(toxicity.fold("a grobian"), lexicon.automaton())[0] > 0


def passages(given, items):
    """(doc, item) with a window of the item's size whose weighted similarity is 0.8 or more, by trying all windows."""

    def bag(w):
        k = min(5, len(w))
        return collections.Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))

    weigh = lambda b: sum(n * sum(len(x.encode()) for x in s) for s, n in b.items())
    out = set()
    for item, it in items.items():
        iw = (it or "").lower().split()
        of = bag(iw) if iw else None
        for doc, t in given.items():
            w = (t or "").lower().split()
            if not iw or not w or len(iw) < 5 and len(w) < len(iw) or len(iw) >= 5 and not any(" ".join(s) in " ".join(w) for s in of):
                continue
            for s in range(max(len(w) - len(iw), 0) + 1):
                b = bag(w[s : s + len(iw)])
                shared = weigh(of & b)
                if shared >= 0.8 * (weigh(of) + weigh(b) - shared):
                    out.add((doc, item))
                    break
    return out


def test_passages(spark, sf, texts, edges, nothing):
    items = {r["item_id"]: r["text"] for r in pq.read_table(f"{sf}/benchmark.parquet").to_pylist()} | {900: "abc", 901: None, 902: "Two Words", 903: ""}
    w = items[0].split()
    given = {**texts, 10**6: " ".join(["x", *w[:-1], "y"]), 10**6 + 1: "two words", 10**6 + 2: " ".join(w[3:]), 10**6 + 3: None, 10**6 + 4: "one ABC two"}
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    want = passages(given, items)
    assert {(r.doc_id, r.item_id) for r in decontaminate.find_passages(docs, bench).collect()} == want
    clean = decontaminate.without_passages(docs, bench)
    assert {r.doc_id for r in clean.collect()} == set(given) - {d for d, _ in want}
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find_passages(edges, bench).collect()) == [(3, 900)]
    assert decontaminate.without_passages(edges, bench).count() == len(EDGES) - 1
    assert decontaminate.find_passages(nothing, bench).count() == 0 and decontaminate.find_passages(docs, bench.where("1 = 0")).count() == 0


def test_hamming_index():
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 63, 30, dtype=np.uint64)
    noisy = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, n).astype(np.uint64)) for n in (1, 8, 14, 18, 22)])
    got = set(zip(*(x.tolist() for x in decontaminate.HammingIndex(base).search(noisy))))
    assert got == {(i, j) for i, q in enumerate(noisy) for j, p in enumerate(base) if int(q ^ p).bit_count() <= 15}


def test_passages_just_above_the_threshold():
    import pyarrow as pa

    r = random.Random(5)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.choice([1, 2, 3, 3, 4, 5, 6, 7, 8, 9, 12]))) for _ in range(3000)]

    def bag(w):
        return collections.Counter({s: sum(len(x) for x in s) * n for s, n in collections.Counter(zip(*(w[i:] for i in range(5)))).items()})

    items, copies = [], []
    while len(items) < 3000:
        w = [r.choice(vocabulary) for _ in range(r.choice([14, 14, 18, 24, 40]))]
        edited = list(w)
        for _ in range(r.randint(1, max(2, len(w) // 20))):
            edited[r.choice([0, len(w) - 1, r.randrange(len(w))])] = r.choice(vocabulary)
        of, other = bag(w), bag(edited)
        if 0.8 <= sum((of & other).values()) / sum((of | other).values()) < 0.85:
            items.append(" ".join(w))
            copies.append(" ".join(edited))
    found = decontaminate.Benchmark(list(range(len(items))), items).matches(pa.array(copies))
    assert [i for i, ms in enumerate(found) if i not in {m[0] for m in ms}] == []


def test_personal_data(spark, texts, edges, nothing):
    def plain(t):
        out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = re.sub("[^0-9]", "", m.group())
            out += [(2, *m.span())] * (16 <= len(d) <= 19 and pii.luhn(d))
        return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]

    r = random.Random(3)
    fuzz = ["".join(r.choice("ab1.@+- ()2345%_é0") for _ in range(r.randint(1, 40))) for _ in range(8000)]
    assert all(pii.base_spans(t) == plain(t) for t in [*texts.values(), *fuzz])
    weights, right, wrong = dict(pii.train()), 0, 0
    for _ in range(300):
        text, gold = pii.sentence(r)
        base, added = pii.find(text, weights)
        right += set(gold) <= {*base, *added}
        wrong += bool(set(added) - set(gold))
        assert not any(a < y and x < b for _, a, b in added for _, x, y in base)
    assert right >= 285 and wrong <= 6
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame([(1, "to a.b@c.de, jo.12 (at) mail (dot) com."), (2, None)], "doc_id bigint, text string")).collect()}
    assert got[1].spans == "email:3:11,email:13:38" and (got[1].n_email, got[1].n_added) == (1, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"email:3:11").hexdigest() and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert pii.find_personal_data(edges).count() == len(EDGES) and pii.find_personal_data(nothing).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("to 8[.]8[.]8[.]8 now", ["8[.]8[.]8[.]8"]),
        ("10[.]0[.]0[.]1", ["10[.]0[.]0[.]1"]),
        ("8(.)8(.)4(.)4 x", ["8(.)8(.)4(.)4"]),
        ("4111 1111 1111 1111 (555) 123-4567", ["4111 1111 1111 1111", "(555) 123-4567"]),
        ("10.20.30.40 (555) 123-4567", ["10.20.30.40", "(555) 123-4567"]),
        ("jo.smith (at) mail (dot) example (dot) com x", ["jo.smith (at) mail (dot) example (dot) com"]),
        ("ann.b.c.d [at] one [dot] two [dot] three [dot] org", ["ann.b.c.d [at] one [dot] two [dot] three [dot] org"]),
        ("card 4111/1111/1111/1111 x", ["4111/1111/1111/1111"]),
        ("x 4 1 1 1  1 1 1 1  1 1 1 1  1 1 1 1 y", ["4 1 1 1  1 1 1 1  1 1 1 1  1 1 1 1"]),
        ("12345678901.12345678901 (at) mail (dot) com", ["12345678901.12345678901 (at) mail (dot) com"]),
        ("v 1[.]2[.]3 and 300[.]1[.]999[.]4", []),
    ],
)
def test_personal_data_of_every_shape(text, want):
    base, added = pii.find(text, dict(pii.train()))
    assert [text[a:b] for _, a, b in sorted(base + added, key=lambda s: s[1])] == want


def test_main_text(spark, sf):
    page = """<html><head><title>x</title></head><body><header class=site-header><h1>Site</h1></header><div id=cookieNotice><p>We use
    cookies and the site is for you and all of the others in it.</p></div><div class="content"><h2>The&nbsp;news</h2><p>This is the text of
    the story and it is long enough to be kept by rules.<p>Short &amp; sweet</p><ul><li>One <a href="x">thing</a> more<li>Two words</ul>
    <!-- no --><p>More of the text is here, and it goes on for a while with the words.</p></div><div class="sidebar"><p>Other stories of the
    day that you may like and read in the site</p></div><section class="comments"><p>I think that the story is not right and the author is
    wrong in it</p></section><form>Your name of the day</form><script>if (a < b) "</p>"</script><footer>All of the rights &copy;</footer>"""
    want = "The news\nThis is the text of the story and it is long enough to be kept by rules.\nShort & sweet\nOne thing more\nTwo words\n"
    assert html.main_text(page) == want + "More of the text is here, and it goes on for a while with the words."
    for h in (r["html"] for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()):
        inside = re.sub("<br>", " ", re.search("<article>(.*?)</article>", h, re.S)[1])
        blocks = (" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside))
        assert html.main_text(h) == "\n".join(b for b in blocks if b)
    odd = [(1, "u", None, 0), (2, None, "", 0), (2, None, "<p", 0), (None, "u", "<div>" * 5000 + "<a \"'" * 500, 0), (3, "u", "<li>a" * 20_000, 0)]
    got = html.extract(spark.createDataFrame(odd, "page_id bigint, url string, html string, text int"))
    assert got.columns == ["page_id", "url", "text", "n_chars"] and got.count() == 5 and all(r.text is not None and r.n_chars == len(r.text) for r in got.collect())
    assert html.extract(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_long_attributes():
    kept = "This is the text of the story and it is long enough to be kept by rules."
    for value in ("<p>x</p>" * 2500, "<svg><article>it is not the text of the page</article></svg>" * 400):
        for quote in "\"'":
            assert html.main_text(f"<div><p>{kept}<img src={quote}{value}{quote}> More</p></div>") == f"{kept} More"
    open_quotes = '<a b=">"' * 100_000
    assert html.main_text(f"<article><p>{kept}</p>{open_quotes}") and html.main_text("<div a='" + "a" * 200_000 + f"><p>{kept}</p>") == kept


@pytest.mark.parametrize(
    "line",
    [
        "Вчера вечером жители города собрались возле старой площади чтобы обсудить новый мост через реку которую давно хотели соединить две части района",
        "Wczoraj wieczorem mieszkańcy miasta zebrali się obok starego rynku aby omówić nowy most przez rzekę która od dawna dzieli dwie części dzielnicy",
        "Dün akşam şehir halkı eski meydanın yanında toplandı ve nehrin üzerine yapılacak yeni köprüyü konuştu çünkü mahalle yıllardır ikiye bölünmüş durumda yaşıyor herkes",
        "Χθες το βράδυ οι κάτοικοι της πόλης μαζεύτηκαν κοντά στην παλιά πλατεία για να συζητήσουν τη νέα γέφυρα πάνω από το ποτάμι μας",
        "어제 저녁 도시 주민들은 오래된 광장 근처에 모여 강을 가로지르는 새로운 다리에 대해 이야기했다 그 강은 오랫동안 두 지역을 나누어 왔고 모두가 그것을 원했다",
        "昨日の夜、町の人々は古い広場の近くに集まり、川に架かる新しい橋について話し合いました。その川は長い間二つの地区を分けてきました。",
        "Ieri sera gli abitanti della città si sono riuniti vicino alla vecchia piazza per discutere del nuovo ponte sopra il fiume che divide due quartieri",
    ],
)
def test_main_text_of_other_languages(line):
    page = f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div>{line}</div><p>1 2</p><div>{line} x</div><div class=footer>{line}</div></body>"
    assert html.main_text(page) == f"{line}\n1 2\n{line} x"


def test_main_text_with_long_code():
    code = "for i = 0; i < n; i++ { x[i] = v[i] + z[i]; } while j < m { j += 1; k -= 1; } return x, v, z, k, j, m, n;"
    story = "This is the text of the story and it is long enough to be kept by the rules of this page, as it goes on for more than the few words that the code below it has."
    page = f"<div><a href=x>Home</a></div><div>{story}</div><pre>{code.replace('<', '&lt;')}</pre><div>{story}</div>"
    assert html.main_text(page) == f"{story}\n{code}\n{story}"


def test_license_notices(spark, texts, edges, nothing):
    known = {"GNU General Public License": "gpl", "CC BY-NC": "cc-by-nc", "MIT License": "mit", "Apache License": "apache"}
    given = {**texts, 10**6: "The license of the story was read under the bridge.\nAll of it.", 10**6 + 1: "x\n\nReleased under the MIT License."}
    docs = spark.createDataFrame(list(given.items()), "doc_id bigint, text string")
    model = licenses.Model(docs)
    got = {(r.doc_id, r.paragraph): r.family for r in licenses.scan(docs, model).where("confirmed").collect()}
    want = {(d, i): f for d, t in given.items() for i, line in enumerate((t or "").split("\n")) for k, f in known.items() if k in line}
    assert got == want and len(want) > 3
    assert licenses.scan(edges, model).count() == 0 and licenses.scan(nothing, model).count() == 0
    assert licenses.Model(nothing).vocabulary


def test_wrapped_license_headers(spark, texts):
    import textwrap

    header = " ".join(licenses.TEMPLATES["gpl"][1:2] + licenses.TEMPLATES["gpl"][3:])
    wrapped = [f" * {line}" for line in textwrap.wrap(header, 70)]
    plain = [t for t in texts.values() if t][:80]
    rows = [(i, "\n".join([*wrapped, f"int x{i} = {i};", "return x;"])) for i in range(40)] + list(enumerate(plain, 40))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = licenses.Model(docs)
    found = licenses.scan(docs.where("doc_id = 0"), model).where("confirmed").collect()
    lines = {r.paragraph for r in found if r.family == "gpl"}
    assert all(i in lines for i, line in enumerate(wrapped) if "General Public License" in line)
    assert all(r.paragraph < len(wrapped) for r in found) and {"free software", "redistribute it"} <= model.lexicon


def test_chat_round_trip(spark):
    r = random.Random(5)
    for _ in range(3000):
        text = "".join(r.choice(["<", "|", "\\", "a", "<|im_end|>", "<\\|", "\n", "<|"]) for _ in range(r.randint(0, 12)))
        cut = r.randint(0, len(text))
        segment, a, b, _ = chat.format_turn("assistant", [{"type": "text", "text": text[:cut]}, {"type": "text", "text": text[cut:]}])
        assert chat.read_turn(segment) == ("assistant", text) and chat.unescape(segment[a:b]) == text
        assert segment.count("<|") == 2
    parts = [("text", "see <|", None, None, None, None, None), ("image", None, "i.png", 600, 500, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("document", None, "d.pdf", None, None, None, 3)]
    turns = spark.createDataFrame([(1, 0, "user\n", parts, 0), (1, 1, "assistant", [("text", "ok", None, None, None, None, None)], 0)], f"conv_id bigint, turn bigint, role string, parts {chat.PARTS}, ord bigint")
    segments = chat.format_turns(turns)
    first = segments.where("turn = 0").first()
    assert first.segment == "<|im_start|>user\\n\nsee <\\|<|image:0|><|audio:1|><|document:2|><|im_end|>\n"
    assert [(x.place, x.type, x.ref, x.tokens) for x in first.attachments] == [(0, "image", "i.png", 425), (1, "audio", "a.wav", 63), (2, "document", "d.pdf", 1800)]
    assert chat.conversation(segments, 1).endswith("<|im_start|>assistant\nok<|im_end|>\n")
    with pytest.raises(ValueError):
        chat.format_turn("user", [{"type": "video"}])
    odd = [(None, None, None, None, 1), (None, None, None, None, 1), (7, 0, "a\nb\\", LONG, 1)]
    rows = spark.createDataFrame(odd, "conv_id bigint, turn bigint, role string, text string, parts int")
    got = {r.conv_id: r for r in chat.digests(chat.format_turns(chat.text_parts(rows))).collect()}
    assert got[None].n_turns == 2 and got[None].turns_sha256 == hashlib.sha256(b"\n\n\n\n").hexdigest() and got[None].loss_chars == 0
    assert got[7].turns_sha256 == hashlib.sha256(f"a\nb\\\n{LONG}\n".encode()).hexdigest()
    assert chat.digests(chat.format_turns(chat.text_parts(rows.where("1 = 0")))).count() == 0


def test_pipeline(spark, sf, texts):
    import corpus_pipeline
    from panelwise.llm.common import scratch, table
    from tests.llm.test_jaccard import brute

    docs = table(spark, sf, "documents")
    done = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        done.append(scratch(stage(spark, done[-1], sf), f"test-stage-{i}"))
    assert all(d.columns == docs.columns for d in done[:-1])
    ids = [collections.Counter(r.doc_id for r in d.select("doc_id").collect()) for d in done]
    lexicon = toxicity.train(docs, table(spark, sf, "labels"))
    assert set(ids[1]) == {r.doc_id for r in toxicity.score(docs, lexicon).where("predicted = 0").collect()}
    assert set(ids[2]) == {c for c, *_ in brute([(d, texts[d]) for d in ids[1]]).values()}
    items = {r.item_id: r.text for r in table(spark, sf, "benchmark").collect()}
    assert set(ids[3]) == set(ids[2]) - {d for d, _ in passages({d: texts[d] for d in ids[2]}, items)}
    times = {r.doc_id: r.taken // r.size for r in mixing.mix_report(done[3]).collect() if r.taken}
    assert ids[4] == times
    plain = Tokenizer.from_file(queries.TOKENIZER)
    sizes = {d: len(plain.encode(texts[d], add_special_tokens=False).ids) + 1 for d in times}
    last = sorted((r.start, r.doc_id, r.n_tokens) for r in done[5].collect())
    at = 0
    for (start, doc, n), want in zip(last, sorted(d for d, k in times.items() for _ in range(k)), strict=True):
        assert (start, doc, n) == (at, want, sizes[want])
        at += n
