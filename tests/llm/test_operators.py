"""Each operator against brute force, an exact round trip, held-out rows or SQL."""

import collections
import io
import itertools

import numpy as np
import pytest
from conftest import same_rows

from sparkloom.llm import language_id, media, pii_crf, queries, secret_novelty, sentencepiece_spans, setsketch, sharding, style_tree

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_sql(spark, name):
    assert same_rows(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_near_duplicates_against_all_pairs(spark, docs):
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    sets = [set(s.tolist()) for s in setsketch.shingles([r["text"] for r in rows])]
    like = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if sets[i] and len(sets[i] & sets[j]) >= setsketch.THRESHOLD * len(sets[i] | sets[j])]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in like:
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    got = {r["doc_id"]: r["group_id"] for r in setsketch.near_duplicates(docs).collect()}
    together = [got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]] for i, j in like]
    assert sum(together) >= 0.9 * len(like) and len(like) > 10
    assert all(find(i) == find(j) for i, j in itertools.combinations(range(len(rows)), 2) if got[rows[i]["doc_id"]] == got[rows[j]["doc_id"]])


def test_setsketch_merges_and_estimates():
    rng = np.random.default_rng(1)
    pool = np.unique(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    a, b = pool[:2000], pool[1000:3000]
    ra, rb, ru = setsketch.registers([a, b, pool[:3000]])
    assert (setsketch.merge(ra, rb) == ru).all()
    j = setsketch.joint_estimate(ra[None], rb[None], np.array([2000.0]), np.array([float(len(b))]))[0]
    assert abs(j - 1 / 3) < 0.13


def test_language_on_held_out_rows(docs):
    rows = [r for r in docs.select("doc_id", "text", "lang").collect() if r["text"] and r["lang"]]
    train, held = [r for r in rows if r["doc_id"] % 2], [r for r in rows if r["doc_id"] % 2 == 0]
    model = language_id.fit([r["text"] for r in train], [r["lang"] for r in train])
    scores, known, many, ok = language_id.score(model, [r["text"] for r in held])
    right = [model["languages"][k] == r["lang"] for k, r, o in zip(scores.argmax(1), held, ok) if o]
    assert np.mean(right) > 0.97 and language_id.accepts(model, scores, known, many)[ok].mean() > 0.98
    _, strange, _, _ = language_id.score(model, ["Мама мыла раму и читала книгу о погоде", "これは日本語の文章です" * 3])
    assert (strange < language_id.MIN_KNOWN).all()


FOREIGN = (
    "Oggi piove molto e la gente resta in casa a leggere il giornale, mentre i bambini giocano con il cane nel cortile della scuola.",
    "Tänään sataa paljon ja ihmiset pysyvät kotona lukemassa sanomalehteä, kun lapset leikkivät koiran kanssa koulun pihalla.",
    "Hoje chove muito e as pessoas ficam em casa lendo o jornal, enquanto as crianças brincam com o cachorro no pátio da escola.",
    "Vandaag regent het veel en de mensen blijven thuis om de krant te lezen, terwijl de kinderen met de hond op het schoolplein spelen.",
    "Idag regnar det mycket och folk stannar hemma och läser tidningen, medan barnen leker med hunden på skolgården.",
    "Gallia est omnis divisa in partes tres, quarum unam incolunt Belgae, aliam Aquitani, tertiam qui ipsorum lingua Celtae appellantur.",
    "Hari ini hujan deras dan orang-orang tinggal di rumah membaca koran, sementara anak-anak bermain dengan anjing di halaman sekolah.",
)


def test_other_languages_of_the_same_script_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(docs)
    rng = np.random.default_rng(6)
    letters = [" ".join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(2, 9))) for _ in range(60)) for _ in range(20)]
    scores, known, many, _ = language_id.score(model, [*FOREIGN, *letters])
    assert not language_id.accepts(model, scores, known, many).any()
    asked = language_id.identify_language(docs, model)
    assert asked.filter("lang_pred is not null and not accepted").count() < 0.02 * docs.count()
    strange = spark.createDataFrame([(1, FOREIGN[0], "xx")], "doc_id long, text string, lang string")
    assert language_id.keep_identified(strange, model).count() == 0


def test_left_out_languages_are_rejected(spark):
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").collect() if r["text"] and r["lang"]]
    for out in ("de", "en", "es", "fr"):
        known = [r for r in rows if r["lang"] != out]
        model = language_id.fit([r["text"] for r in known], [r["lang"] for r in known])
        scores, share, many, _ = language_id.score(model, [r["text"] for r in rows if r["lang"] == out and len(r["text"]) > 400])
        assert language_id.accepts(model, scores, share, many).mean() < 0.1


def test_kernel_scores_are_those_of_the_kernel():
    texts, labels = ["the river and the town", "der fluss und die stadt", "a green hill of the house", "ein haus und ein berg"], ["en", "de", "en", "de"]
    model = language_id.fit(texts, labels)
    x, _ = language_id.presence(texts + ["the house and the town"])
    x = x * language_id._SCALE
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    chosen = [i for lang in ("de", "en") for i in np.random.default_rng(7).permutation([k for k, v in enumerate(labels) if v == lang])]
    k = x @ x.T
    y = np.array([[1.0 if v == lang else -1.0 for lang in ("de", "en")] for v in labels])
    nm, mm = k[:4][:, sorted(chosen)].astype(float), k[np.ix_(sorted(chosen), sorted(chosen))].astype(float)
    alpha = np.linalg.solve(nm.T @ nm + language_id.RIDGE * mm + 1e-6 * np.eye(4), nm.T @ y)
    want = k[4, sorted(chosen)] @ alpha
    assert np.allclose(language_id.score(model, ["the house and the town"])[0][0], want, atol=1e-3)


def test_pieces_round_trip_and_spans(docs):
    codec = sentencepiece_spans.codec()
    texts = [r["text"] for r in docs.select("text").collect()][:60] + ["a  b\n\tc ", "日本語 und €", " lead", "tail  "]
    for text, (ids, offsets) in zip(texts, codec.encode(texts)):
        data = text.encode()
        assert codec.decode(ids.tolist()) == text
        assert offsets[0] == 0 and offsets[-1] == len(data) and (np.diff(offsets) >= 0).all()
        slow = codec.slow(text)
        assert (slow[0] == ids).all() and (slow[1] == offsets).all()
        for i, a, b in zip(ids.tolist(), offsets[:-1], offsets[1:]):
            if i not in codec.byte and i != codec.unknown:
                assert data[a:b].replace(b" ", b"") == codec.surface[i].replace(b" ", b"")


def test_pieces_are_the_librarys(docs):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_spans.MODEL)
    texts = [r["text"] for r in docs.select("text").collect()][:80]
    assert [g[0].tolist() for g in sentencepiece_spans.codec().encode(texts)] == own.encode(texts)


def test_pii_on_held_out_sentences():
    field, right, said, there = pii_crf.field(), 0, 0, 0
    cases = list(pii_crf._examples(99, 400))
    for (text, marks), got in zip(cases, pii_crf.entities(field, [t for t, _ in cases])):
        found = {(a, b, label) for a, b, label, _ in got}
        right, said, there = right + len(found & set(marks)), said + len(found), there + len(marks)
    assert right / said > 0.95 and right / there > 0.93


def test_pii_repeats_agree_and_decoys_stay():
    text = "call +1 (555) 555-0134 now. " + "word " * 50 + "again +1 (555) 555-0134 and version 1.2.3, card 4111 1111 1111 1111, item 12345"
    got = pii_crf.entities(pii_crf.field(), [text])[0]
    assert [e[2] for e in got] == ["PHONE", "PHONE", "CARD"]


def test_loopy_messages_are_exact_on_a_tree():
    rng = np.random.default_rng(0)
    L = pii_crf.L
    f = pii_crf.Field(rng.normal(size=(pii_crf.N_FEATURES, L)), rng.normal(size=(L, L)), rng.normal(size=(L, L)))
    feats, joined, pairs = [[0, 1], [2], [3]], [False, True, False], [(1, 2)]
    weights = {}
    for y in itertools.product(range(L), repeat=3):
        s = sum(f.unary[x].sum(0)[y[i]] for i, x in enumerate(feats))
        s += f.chain[0][y[0]] + f.chain[y[0]][y[1]] + f.chain[:, 0][y[1]] + f.chain[0][y[2]] + f.chain[:, 0][y[2]] + f.skip[y[1]][y[2]]
        weights[y] = np.exp(s)
    total = sum(weights.values())
    got = f.marginals([(feats, joined, pairs)])[0]
    for i in range(3):
        want = [sum(w for y, w in weights.items() if y[i] == k) / total for k in range(L)]
        assert np.allclose(got[i], want, atol=1e-3)


def test_secrets():
    hidden = "9f8c2d7b61e04a35b8f1c6d29e7a0b43"
    text = f'config: api_key = "{hidden}" and password = "changeme123" token: get_token_value\nBearer {hidden}'
    reported = {text[a:b] for a, b, _, _, _, said, _ in secret_novelty.scan(text) if said}
    assert reported == {hidden}
    assert not any(c[5] for c in secret_novelty.scan('password = "example-placeholder" secret_key = os.environ'))


def test_images():
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (37, 53, 3)).astype(np.uint8)
    grey = image[:, :, :1]
    ppm = b"P6\n# note\n53 37\n255\n" + image.tobytes()
    plain = b"P3\n53 37\n255\n" + b" ".join(str(v).encode() for v in image.reshape(-1))
    pam = b"P7\nWIDTH 53\nHEIGHT 37\nDEPTH 3\nMAXVAL 255\nENDHDR\n" + image.tobytes()
    for data in (ppm, plain, pam, media.write_bmp(image)):
        assert (media.decode(data)[0] == image).all()
    assert (media.decode(media.write_bmp(grey))[0][:, :, :1] == grey).all()
    bits = grey[:, :, 0] > 127
    pbm = b"P4 53 37\n" + np.packbits(bits, axis=1).tobytes()
    assert (media.decode(pbm)[0][:, :, 0] == np.where(bits, 0, 255)).all()
    even = rng.integers(0, 256, (40, 60, 3)).astype(np.uint8)
    means = even.reshape(10, 4, 12, 5, 3).mean((1, 3))
    assert np.abs(media.resize(even, 10, 12).astype(float) - means).max() <= 0.5001
    rows = media.image_tiles(ppm, 64, 32)
    assert len(rows) == 4
    small = media.resize(image, 64, 64)
    for r in rows:
        assert (np.load(io.BytesIO(r[7])) == small[r[5] * 32 :][:32, r[6] * 32 :][:, :32]).all()
    assert media.image_tiles(b"P6 9 9 255\n123")[0][-1] == "truncated" and media.image_tiles(None)[0][-1] == "empty" and media.image_tiles(b"GIF89a")[0][-1] == "unknown format"


def _spread(counts, pages):
    """Entropy of counts by page, to the base of the number of pages."""
    total = sum(counts)
    return -sum(c / total * np.log(c / total) for c in counts) / np.log(pages)


def _importance(held, leaf):
    """Of {item: {page: count}}: one minus the mean entropy of a leaf's items over the pages, or the entropy of an element's styles."""
    pages = sum(len({p for by in held.values() for p in by if p[1] == node}) for node in {p[1] for by in held.values() for p in by})
    if pages < 2:
        return 1.0
    raw = 1 - np.mean([_spread(list(by.values()), pages) for by in held.values()]) if leaf else _spread([sum(by.values()) for by in held.values()], pages)
    return min(1.0, max(0.0, round(float(raw), 9)))


def _brute_force(pages):
    """Each page's text by the merged tree, in memory: nodes are (site, chain of styles and places), by recursion."""
    parsed = [(page_id, url.split("/")[2], style_tree.Page(html)) for page_id, url, html in pages]
    node_of, held, pool, about, children = {}, collections.defaultdict(lambda: collections.defaultdict(collections.Counter)), collections.defaultdict(lambda: collections.defaultdict(collections.Counter)), {}, collections.defaultdict(set)
    for n, (_, site, page) in enumerate(parsed):

        def walk(i, node, path):
            leaf = page.tags[i] in ("#text", "#ref") and not page.children[i]
            runs = [(k, list(g)) for k, g in itertools.groupby(page.children[i], key=lambda c: page.keys[c])]
            style = tuple(k for k, _ in runs)
            item = page.values[i] if leaf else style
            node_of[n, i], about[node] = node, (leaf, path)
            held[node][item][n, node] += 1
            pool[path, leaf][item][n, node] += 1
            for place, (key, own) in enumerate(runs):
                for c in own:
                    below = (node, style, place)
                    children[node, style].add(below)
                    walk(c, below, (*path, key))

        walk(0, (site,), ())
    value, best = {}, {}

    def weigh(node):
        leaf, path = about[node]
        pages = len({p for by in held[node].values() for p in by})
        own = round(((pages - 1) * _importance(held[node], leaf) + style_tree.POOLED * _importance(pool[path, leaf], leaf)) / (pages - 1 + style_tree.POOLED), 9)
        kids = [] if leaf else [(sum(by.values()), sorted(children[node, style])) for style, by in held[node].items() if children[node, style]]
        for _, ks in kids:
            for k in ks:
                weigh(k)
        value[node] = best[node] = own
        if kids:
            damp = style_tree.GAMMA ** len(held[node])
            value[node] = (1 - damp) * own + damp * sum(t * sum(value[k] for k in ks) / len(ks) for t, ks in kids) / sum(t for t, _ in kids)
            best[node] = max(value[node], *(best[k] for _, ks in kids for k in ks))

    for site in {s for _, s, _ in parsed}:
        weigh((site,))
    return {page_id: page.text({i for i in range(len(page.tags)) if best[node_of[n, i]] < style_tree.LEAST}) for n, (page_id, _, page) in enumerate(parsed)}


def _site(n=90):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    menu = '<nav><ul><li><a href="/home">Home</a><li><a href="/news">News</a></ul></nav>'
    return [(i, f"https://a.example/p{i}", f"<html><body>{menu}<div class=ad>Buy {i % 3} now</div><article><h1>{word()} {word()}</h1>" + "".join(f"<p>{word()} <b>{word()}</b> {word()}" for _ in range(1 + i % 3)) + "</article><footer>&copy; a.example</footer><script>x('<p>')</script></body></html>") for i in range(n)]


def test_style_tree_against_brute_force(spark):
    rows = _site() + [(1000, "https://b.example/", "<p>only page <a href=/x>link</a>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = _brute_force(rows)
    for nodes in (style_tree.BROADCAST_NODES, -1):
        got = {r["page_id"]: r["text"] for r in style_tree.extract(df, nodes).collect()}
        assert got == want
    assert got[1000] == "only page link"
    small = [(i, f"https://s{i % 20}.example/p{i}", h) for i, _, h in _site(100)]  # five pages a site, of one template
    df = spark.createDataFrame(small, "page_id long, url string, html string")
    shared = {r["page_id"]: r["text"] for r in style_tree.extract(df).collect()}
    assert shared == _brute_force(small) and not any("Home" in t or "Buy" in t for t in shared.values())
    assert all(len(t.split()) >= 5 for t in shared.values())
    page = got[5]
    assert "Home" not in page and "Buy" not in page and "a.example" not in page and len(page.split()) == 2 + 3 * 3


def test_style_tree_keeps_articles_of_given_pages(spark):
    import re

    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").filter("url like '%tionsh.example%'")
    rows = {r["page_id"]: r["html"] for r in pages.select("page_id", "html").collect()}
    kept = total = 0
    for r in style_tree.extract(pages).collect():
        html = rows[r["page_id"]]
        body = re.search("<article>(.*?)</article>", html, re.S)
        article = style_tree.text_of(body[1]) if body else ""
        have = collections.Counter(r["text"].split())
        kept, total = kept + sum((collections.Counter(article.split()) & have).values()), total + len(article.split())
    assert kept > 0.97 * total


def test_shards_are_ordered_and_balanced(spark, docs):
    target = 60_000
    out = sharding.shard(docs, target).selectExpr("shard", "row.source", "row.doc_id", f"octet_length(row.text) + {sharding.RECORD_BYTES} as size").collect()
    assert len(out) == docs.count()
    sizes, keys = collections.Counter(), collections.defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        keys[r["shard"]].append((r["source"], r["doc_id"]))
    largest = max(r["size"] for r in out)
    assert max(sizes.values()) <= sharding.LIMIT * target + largest
    order = sorted(keys)
    assert all(max(keys[a]) < min(keys[b]) for a, b in zip(order, order[1:]))
