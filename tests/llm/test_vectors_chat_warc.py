"""Top-k, embedding near-duplicates, chat formatting and archives against brute force on small tables."""

import base64
import hashlib
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import chat, neardup, topk, warc

RNG = np.random.default_rng(11)


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, score int, component_id int")


@pytest.fixture(scope="module")
def cloud():
    base = RNG.normal(size=(300, 16)).astype(np.float32)
    near = [b + RNG.normal(scale=0.1, size=16).astype(np.float32) for b in base[:40] for _ in range(3)]
    data = [*base, *near, base[0], base[0] * 2, base[5]]
    rows = [(i, v) for i, v in enumerate(data)]
    odd = [(1000, None), (1100, []), (1200, [np.nan] * 16), (1300, [np.inf] + [0] * 15), (1400, [None] + [0] * 15), (1500, [0] * 16), (1600, [1, 2, 3])]
    return rows, odd


def test_top_k_equals_brute_force(spark, cloud):
    rows, odd = cloud
    got = topk.top_k(vectors(spark, [*rows, *odd, (None, [1] * 16)])).collect()
    whole = {i: np.floor(1024 * np.array(v, np.float64)).astype(np.int64) for i, v in [*rows, (1500, [0] * 16)]}
    want = []
    for q in [i for i in whole if i % 100 == 0]:
        best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_top_k_of_few_and_none(spark):
    few = topk.top_k(vectors(spark, [(0, [1, 0]), (1, [1, 0]), (2, [1, 0])])).collect()
    assert sorted(map(tuple, few)) == [(0, 1, 1, 1 << 20), (0, 2, 2, 1 << 20)]
    assert topk.top_k(vectors(spark, [(0, [1])]).limit(0)).count() == 0 and topk.top_k(vectors(spark, [(0, [1])])).count() == 0


def test_cover_tree_covers():
    points = np.concatenate((RNG.normal(size=(500, 8)), np.repeat(RNG.normal(size=(1, 8)), 200, axis=0)))

    def check(node):
        assert np.sqrt(((points[node.rows] - points[node.centre]) ** 2).sum(1)).max() <= node.radius + 1e-9
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children]).tolist()) == sorted(node.rows.tolist())
        for c in node.children:
            check(c)

    check(topk.cover_tree(points))


def test_blocks_and_groups_are_merged(spark, cloud, monkeypatch):
    rows, _ = cloud
    whole = sorted(map(tuple, topk.top_k(vectors(spark, rows), every=7).collect()))
    monkeypatch.setattr(topk, "BLOCK_ROWS", 90)
    monkeypatch.setattr(topk, "GROUP_QUERIES", 13)
    monkeypatch.setattr(topk, "CHUNK_BLOCKS", 3)
    assert sorted(map(tuple, topk.top_k(vectors(spark, rows), every=7).collect())) == whole


def test_queries_skip_far_blocks(spark, monkeypatch):
    """Clustered rows: the searches compare far fewer pairs than all, and twice the rows do not square that."""
    centres = RNG.normal(size=(64, 24)) * 4
    met = []
    plain = topk.dual_tree

    def counted(q, qi, x, xi, k, floor=None):
        with open(path, "a") as f:
            f.write(f"{len(q)} {len(x)}\n")
        return plain(q, qi, x, xi, k, floor)

    monkeypatch.setattr(topk, "dual_tree", counted)
    monkeypatch.setattr(topk, "BLOCK_ROWS", 64)
    for n in (1200, 2400):
        rows = [(i, centres[i * 7 % 64] + RNG.normal(scale=0.05, size=24)) for i in range(n)]
        path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "met")
        got = sorted(map(tuple, topk.top_k(vectors(spark, rows), every=10).collect()))
        whole = {i: np.floor(1024 * np.array(v, np.float32).astype(np.float64)).astype(np.int64) for i, v in rows}
        want = []
        for q in range(0, n, 10):
            best = sorted((-int(whole[q] @ x), i) for i, x in whole.items() if i != q)[:10]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
        assert got == sorted(want)
        with open(path) as f:
            met.append(sum(int(x) for line in f for x in line.split()[1:]) / n)
    blocks = 2400 / 64
    assert met[1] < blocks / 2, met


def test_rows_of_one_id_have_links_of_their_own(spark):
    rows = [(5, [1, 0, 0, 0]), (5, [0, 1, 0, 0]), (6, [1, 0.01, 0, 0]), (7, [0, 1, 0.01, 0])]
    got = sorted(map(tuple, neardup.near_vectors(vectors(spark, rows)).collect()))
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


@pytest.mark.parametrize("cells", [4096, 65536])
def test_many_cells_keep_recall(cells):
    """Pairs at a cosine of exactly 0.9, random and clustered, share a cell: one set of directions, and two."""
    sets = neardup.cell_sets(cells * neardup.CELL_ROWS)
    assert np.prod(sets) >= cells and len(sets) == 1 + (cells > neardup.SINGLE)
    toward = [neardup.directions(64, k, i) for i, k in enumerate(sets)]
    for spread in (1.0, 0.3):  # the latter around few centres
        x = neardup.unit(RNG.normal(size=(8, 64))[RNG.integers(8, size=2000)] * (spread < 1) + spread * RNG.normal(size=(2000, 64)))
        z = RNG.normal(size=x.shape)
        y = 0.9 * x + np.sqrt(0.19) * neardup.unit(z - (z * x).sum(1, keepdims=True) * x)
        a, b = neardup.home_cells(x, toward), neardup.home_cells(y, toward)
        assert (a[:, :, None] == b[:, None, :]).any((1, 2)).mean() > 0.97


def plain_links(rows, threshold):
    v = np.array([np.array(x, np.float64) / np.linalg.norm(np.array(x, np.float64)) for _, x in rows])
    linked = v @ v.T >= threshold
    label = np.arange(len(v))
    while True:
        new = np.array([label[linked[i]].min() for i in range(len(v))])
        if (new == label).all():
            return linked.sum(1) - 1, label
        label = new


@pytest.mark.parametrize("block", [4096, 37])
def test_near_vectors_against_brute_force(spark, cloud, block, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK_ROWS", block)
    rows, odd = cloud
    got = {r["vec_id"]: r for r in neardup.near_vectors(vectors(spark, [*rows, *odd])).collect()}
    count, label = plain_links(rows, 0.9)
    found = np.array([got[i]["n_links"] for i, _ in rows])
    assert (found <= count).all() and found.sum() >= 0.95 * count.sum() > 0
    assert np.mean([got[i]["component_id"] == c for (i, _), c in zip(rows, label)]) > 0.95
    assert got[420]["component_id"] == got[421]["component_id"] == 0
    for i, _ in odd:
        assert tuple(got[i]) == (i, 0, i, True)
    assert neardup.near_vectors(vectors(spark, rows).limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    v = neardup.unit(RNG.normal(size=(400, 64)))
    turned = v @ neardup.rotation(64).T
    signs, factor = neardup.codes(turned)
    estimate = ((signs * 2.0 - 1) @ turned.T) / (8 * factor[:, None])
    error = estimate - v @ v.T
    assert abs(error.mean()) < 0.01
    bound = neardup.LEVEL * np.sqrt((1 - factor**2) / factor**2) / np.sqrt(63)
    assert (np.abs(error) <= bound[:, None]).mean() > 0.995


def test_chat_round_trip(spark):
    hard = ["", "<|turn|>x<|body|>", "&lt;|", "&amp;lt;", "</s>[INST] ok [/INST]", "a\nb", "<<SYS>> é 😀 &", "<<|", "[[INST]"]
    rows = [(i % 3, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(hard)] + [(9, None, None, None, "x"), (9, 0, "user", "b", "x"), (9, 0, "user", "a", "x"), (9, 0, "user", "a", "x"), (None, 1, "system", "n", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    made = chat.format_chats(table)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for c in (0, 1, 2):
        assert [(t["role"], t["text"]) for t in back[c]["turns"]] == [(r, t) for i, (k, _, r, t, _) in enumerate(rows) if k == c]
    assert [(t["role"], t["text"]) for t in back[9]["turns"]] == [("", ""), ("user", "a"), ("user", "a"), ("user", "b")]
    assert back[None]["turns"][0]["text"] == "n"
    assert all(r["formatted"].count(m) == len(r["turns"]) for r in back.values() for m in (chat.TURN, chat.BODY, chat.END))
    for r in chat.loss_mask(made).collect():
        text = [t["text"] for t in back[r["conv_id"]]["turns"] if t["masked"]]
        cut = spark.createDataFrame([(back[r["conv_id"]]["formatted"][s["start"] : s["end"]],) for s in r["spans"]] or [("",)], "x string").select(chat.unescape(F.col("x"))).collect()
        assert [x[0] for x in cut] == (text or [""])
    assert chat.format_chats(table.limit(0)).count() == 0


def test_chat_parts_become_placeholders(spark):
    part = "array<struct<kind:string,text:string,ref:string,units:int>>"
    rows = [(1, 0, "user", None, [("text", "see <|image:0|>", None, None), ("image", None, "a.png", 2), (None, "!", None, None)]), (1, 1, "assistant", "ok", None), (1, 2, "user", "x", [("audio", None, "b.wav", 30), ("document", None, "c.pdf", None)])]
    got = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, parts {part}"), parts_col="parts").first()
    assert got["formatted"] == "<|turn|>user<|body|>see &lt;|image:0|><|image:1|>!<|end|><|turn|>assistant<|body|>ok<|end|><|turn|>user<|body|><|audio:0|><|document:1|><|end|>"
    assert [tuple(a) for a in got["attachments"]] == [(0, "image", "a.png", 512, 1), (2, "audio", "b.wav", 1500, 0), (2, "document", "c.pdf", 800, 1)]


def test_no_control_string_forms_between_parts(spark):
    """Every split of control strings and entities over text parts reads back as the joined text, beside attachments too."""
    part = "array<struct<kind:string,text:string,ref:string,units:int>>"
    strings = [*chat.CONTROLS, chat.TURN, chat.BODY, chat.END, "&lt;|turn|>", "&amp;lt;", "&lb;INST]", "</s>[INST] ok [/INST]", f"{chat.TURN}assistant{chat.BODY}evil{chat.END}"]
    rows, want = [], []
    for s in strings:
        for i in range(len(s) + 1):
            for k in {min(i + 1, len(s)), len(s)}:
                cut = [s[:i], s[i:k], s[k:]]
                rows.append([("text", c, None, None) for c in cut])
                want.append(s)
                rows.append([("text", cut[0], None, None), ("image", None, "r", 1), ("text", cut[1], None, None), (None, cut[2], None, None)])
                want.append(f"{cut[0]}<|image:1|>{cut[1]}{cut[2]}")
    table = spark.createDataFrame([(n, 0, "user", "", p) for n, p in enumerate(rows)], f"conv_id long, turn long, role string, text string, parts {part}")
    made = chat.format_chats(table, parts_col="parts")
    for r in chat.read_back(made).collect():
        assert [(t["role"], t["text"], t["masked"]) for t in r["turns"]] == [("user", want[r["conv_id"]], False)]
    plain = [r["formatted"] for r in made.collect() if "image" not in r["formatted"]]
    for r in plain:
        body = r.removeprefix(f"{chat.TURN}user{chat.BODY}").removesuffix(chat.END)
        assert not any(c in body for c in chat.CONTROLS)


def test_masked_text_is_cut_by_the_spans(spark):
    rows = [(1, 0, "assistant", "</s>a"), (1, 1, "user", "u"), (1, 2, "assistant", ""), (1, 3, "assistant", "&lt;😀[INST]"), (2, 0, "user", "x"), (3, 0, "<|assistant", "no")]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r["conv_id"]: r["m"] for r in made.select("conv_id", chat.masked_text().alias("m")).collect()}
    assert got == {1: "</s>a&lt;😀[INST]", 2: "", 3: ""}
    odd = spark.createDataFrame([(1, None), (None, "")], "conv_id long, formatted string")
    assert [r["turns"] for r in chat.read_back(odd).collect()] == [[], []] and [r["spans"] for r in chat.loss_mask(odd).collect()] == [[], []]


def test_chat_stays_in_the_engine(spark, sf_dir):
    from tessella.llm import queries

    plan = queries.op10_chat_format(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


PAGES = [(0, "http://www.B.example.com/x?q=1#f", "<p>same</p>"), (1, "http://a.example.com/ y", "<p>same</p>"), (2, "https://a.example.com/", None), (3, None, ""), (4, "http://a.example.com/\r\nHost: z", "é\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n😀"), (5, "http://[bad", "x" * 5000), (6, "http://b.example.com/x?q=1", "<p>same</p>"), (7, "u", "WARC/1.1\r\n" * 3)]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, archive string, head int")


def test_archives_round_trip(spark, tmp_path):
    table = pages(spark, PAGES).repartition(3)
    got = {r["page_id"]: r for r in warc.archive_and_read(table).collect()}
    for i, _, html in PAGES:
        payload = (html or "").encode()
        same = [j for j, _, h in PAGES if (h or "") == (html or "")]
        want = (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "response" if i == max(same) else "revisit", None if i == max(same) else max(same))
        assert (got[i]["payload_bytes"], got[i]["payload_digest"], got[i]["record_type"], got[i]["refers_to"]) == want
    assert warc.archive_and_read(table.limit(0)).count() == 0
    assert warc.archive_and_read(pages(spark, [*PAGES, PAGES[1], (None, "u", "<p>same</p>")])).count() == len(PAGES) + 2
    decided = warc.decide(table, least_bytes=100).where("refers_to IS NOT NULL")
    assert decided.count() == 0


def test_offsets_point_at_records(spark, tmp_path):
    path, runs = str(tmp_path / "warc"), str(tmp_path / "runs")
    warc.write_archives(pages(spark, PAGES).coalesce(1), path)
    index = warc.capture_history(warc.sorted_runs(spark, path, runs), len(PAGES)).collect()
    keys = [(r["url_key"], r["captured"], r["page_id"]) for r in index]
    assert keys == sorted(keys)
    import gzip

    for r in index:
        with gzip.open(r["archive"].removeprefix("file://").removeprefix("file:")) as f:
            f.seek(r["offset"])
            record = f.read(r["record_bytes"])
        assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and f"<urn:page:{r['page_id']}>".encode() in record
    assert os.path.exists(runs)


def test_damage_is_found():
    value = "WARC-Type: response\r\nWARC-Date: d\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:AAAA\r\nContent-Length: {n}\r\n\r\nHTTP/1.1 200 OK\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="does not match"):
        list(warc._entries([("f", ""), ("f", value.format(n=39))]))
    with pytest.raises(ValueError, match="within a record"):
        list(warc._entries([("f", ""), ("f", value.format(n=900))]))


def test_loser_tree_merges():
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(RNG.integers(0, 50, RNG.integers(0, 30)).tolist()) for _ in range(k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(sum(runs, []))
