import random

import pytest
from pyspark.sql import functions as F

from pagewright.operators import layout, records, tables, timeline, vocabulary
from pagewright.plans.registry import Pipeline, PipelineError, component
from pagewright.plans import stages  # noqa: F401
from pagewright.sources import documents, sinks
from pagewright.streaming import files


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(1, "1. The quick brown fox\n2. jumps over"), (2, ""), (3, None), (4, "one")], "doc_id bigint, text string")


def test_words_and_lines(spark, docs):
    w = layout.words(docs)
    rows = w.orderBy("doc_id", "word_idx").collect()
    assert [(r.doc_id, r.text) for r in rows] == [(1, t) for t in "1. The quick brown fox 2. jumps over".split()] + [(4, "one")]
    lines = layout.line_texts(layout.quick_lines(w)).orderBy("doc_id", "line_idx").collect()
    assert lines[0].text == "1. The quick brown fox 2. jumps over"
    assert layout.words(docs.limit(0)).count() == 0


def test_markers_and_sequence(spark, docs):
    found = layout.markers(layout.words(docs)).orderBy("idx").collect()
    assert [(r.num_text, r.num_val) for r in found] == [("1", 1)]
    rows = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 5), (1, 4, 6), (1, 5, 1)], "g int, o int, v int")
    assert [(r.o, r.expected) for r in layout.sequence_errors(rows, ("g",), ("o",), "v").collect()] == [(3, 3)]


def test_full_lines(spark):
    cells = [(1, 0, k, t, 20 + k % 3 * 200, 10 + k // 3 * 40, 120 + k % 3 * 200, 22 + k // 3 * 40) for k, t in enumerate("alpha beta gamma delta epsilon zeta".split())]
    page = spark.createDataFrame(cells, "doc_id bigint, page_idx int, word_idx int, text string, xmin int, ymin int, xmax int, ymax int")
    numbers = {r.word_idx: r.line_num for r in layout.full_lines(page).collect()}
    assert numbers[0] == numbers[1] == numbers[2] < numbers[3] == numbers[4] == numbers[5]
    assert layout.full_lines(page).count() == page.count()


def test_serial_rule_against_loop(spark):
    rng = random.Random(3)
    data = [(t, k, rng.choice([None, 0, k, k, k, k + 1])) for t in range(60) for k in range(1, 9)]
    found = {(r.t, r.k) for r in tables.serial_errors(spark.createDataFrame(data, "t int, k int, v int"), "t", "k", "v").collect()}
    expected = set()
    for t in range(60):
        want = None
        for _, k, v in [d for d in data if d[0] == t]:
            if v:
                if want is not None and v != want:
                    expected.add((t, k))
                want = v + 1
            elif want is not None:
                expected.add((t, k))
                want += 2
    assert found == expected


def test_merge_ranges_and_clusters(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 4, 9), (1, 30, 40)], "g int, a int, b int")
    assert sorted((r.start, r.end) for r in tables.merged_ranges(rows, ("g",), "a", "b", 2).collect()) == [(0, 9), (30, 40)]
    values = spark.createDataFrame([(1, float(v)) for v in (1, 2, 4, 9, 10)], "g int, v double")
    assert [(r.leader, r.n_members) for r in tables.leader_clusters(values, "g", "v", 2).orderBy("cluster_idx").collect()] == [(1.0, 2), (4.0, 1), (9.0, 2)]
    assert tables.merged_lines(values, "g", "v", 1.5).first().lines == [1.5, 4.0, 9.5]


def test_polygons():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert tables.clipped_area(square, [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]) == pytest.approx(1.0)
    assert tables.clipped_area(square, [(1.0, 3.0), (3.0, 3.0), (3.0, 1.0), (1.0, 1.0)]) == pytest.approx(1.0)
    assert tables.clipped_area(square, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]) == 0
    assert set(tables.hull([(0, 0), (2, 0), (1, 1), (2, 2), (0, 2)])) == {(0, 0), (2, 0), (2, 2), (0, 2)}


def test_vocabulary(spark):
    vocab = spark.createDataFrame(list(enumerate("the quick brown fox jumped over lazy a of".split())), "pos int, text string")
    words = spark.createDataFrame(list(enumerate("A qu ick bromn fox jumbed ov9r the l azy fox.".lower().split())), "i int, text string").withColumn("g", F.lit(1))
    merged = vocabulary.merged(words, vocab, ("g",), "i")
    fixed = vocabulary.corrected(merged, vocab, 1).orderBy("i")
    assert " ".join(r.corrected for r in fixed.collect()) == "a quick brown fox jumped over the lazy fox."
    assert vocabulary.fuzzy(words, vocab, 1).where("text = 'bromn'").first().entry == "brown"
    assert {r.text for r in vocabulary.todo(words, vocab).collect()} >= {"bromn", "qu"}


def test_hierarchy(spark):
    tree = spark.createDataFrame([(1, None, "Asia"), (2, 1, "India"), (3, 1, "China")], "node_id bigint, parent_id bigint, name string")
    texts = spark.createDataFrame([(1, "in India, Asia and China"), (2, "Indiana"), (3, None), (4, "")], "k int, text string")
    found = vocabulary.named_spans(texts, tree, "k")
    assert sorted((r.k, r.node_id, r.start, r.end) for r in found.collect()) == [(1, 1, 10, 14), (1, 2, 3, 8), (1, 3, 19, 24)]
    groups = vocabulary.grouped_spans(found, texts, tree, "k")
    assert sorted(tuple(r.node_ids) for r in groups.collect()) == [(2, 1), (3,)]
    assert [tuple(r.node_ids) for r in vocabulary.selected(groups, "k", "left_most").collect()] == [(2, 1)]
    assert {(r.node_id, r.ancestor_id, r.distance) for r in vocabulary.closure(tree).collect()} == {(1, 1, 0), (2, 2, 0), (3, 3, 0), (2, 1, 1), (3, 1, 1)}
    assert vocabulary.selected(groups, "k", "non_overlapping").count() == 2


def test_selections_against_loops(spark):
    groups = [(1, 0, [2, 1], [5, 12], [10, 16]), (1, 1, [3], [5], [9]), (1, 2, [4], [20], [30]), (1, 3, [4], [20], [30]), (2, 0, [3], [0], [4]), (2, 1, [2], [2], [8]), (2, 2, [2, 1], [40, 50], [45, 54])]
    frame = spark.createDataFrame(groups, "k int, group_id int, node_ids array<bigint>, starts array<int>, ends array<int>")
    got = lambda name: sorted((r.k, r.group_id) for r in vocabulary.selected(frame, "k", name).collect())
    total = lambda g: sum(e - s for s, e in zip(g[3], g[4]))
    gap = lambda g: max(g[4]) - min(g[3]) - total(g)

    def best(measure, which=groups):
        return sorted((g[0], g[1]) for g in which if measure(g) == max(measure(x) for x in which if x[0] == g[0]))

    two = [g for g in groups if len(g[2]) > 1]
    assert got("left_most") == best(lambda g: -min(g[3])) and got("sum_span_len") == got("sum_matching_len") == best(total)
    assert got("connected_sum_span_len") == best(total, two) and got("deeper") == best(lambda g: len(g[2])) and got("inv_span_gap") == best(lambda g: -gap(g)) and got("first") == best(lambda g: -g[1])
    assert got("none") == sorted((g[0], g[1]) for g in groups) and got("at_start") == [(2, 0)] and got("unique") == [(1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (2, 2)]
    assert got("non_overlapping") == [(1, 0), (1, 3), (2, 1), (2, 2)]


def test_trees(spark):
    text = "name: Gov\nalias: [Government]\nministries:\n  - name: Ministry of Home\n    code: 7\n    departments: [{name: Police}]\n  - name: Ministry of Law\n"
    rows = vocabulary.tree_of(text, expand=(("Ministry of", "M/o"),))
    assert [(r[0], r[1], r[2], r[3], r[4], r[5], r[6]) for r in rows] == [
        (0, None, "Gov", ["Government"], None, [], {}), (1, 0, "Ministry of Home", ["M/o Home"], "ministries", ["Gov"], {"code": "7"}), (2, 1, "Police", [], "departments", ["Gov", "Ministry of Home"], {}), (3, 0, "Ministry of Law", ["M/o Law"], "ministries", ["Gov"], {}),
    ]
    assert [r[2] for r in vocabulary.tree_of(text, ("departments",))] == ["Gov", "Ministry of Home", "Ministry of Law"]
    with pytest.raises(ValueError, match="several levels"):
        vocabulary.tree_of("name: a\nb: [{name: x}]\nc: [{name: y}]")
    assert [r.name for r in vocabulary.tree_names(vocabulary.read_tree(spark, text)).collect()] == ["Government", "Gov", "Ministry of Home", "Police", "Ministry of Law"]
    deep = spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "node_id bigint, parent_id bigint")
    assert {(r.node_id, r.ancestor_id, r.distance) for r in vocabulary.closure(deep).collect()} == {(a, b, a - b) for a in range(70) for b in range(a + 1)}
    with pytest.raises(vocabulary.Circular):
        vocabulary.closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "node_id bigint, parent_id bigint"))
    assert vocabulary.closure(deep.limit(0)).count() == 0


def test_unknown_edits_and_missing_words_are_errors(spark, docs):
    w = layout.words(docs)
    kind = "doc_id bigint, seq int, cmd string, args array<string>"
    for cmd, args in (("explode", ["pa0.wo0"]), ("clearWord", ["pa0.wo99"]), ("clearWord", ["pa7.wo0"]), ("clearWord", ["word"])):
        if args != ["word"]:
            with pytest.raises(Exception, match="explode|isn't a word"):
                records.apply_edits(w, spark.createDataFrame([(1, 0, cmd, args)], kind)).collect()
    deleted = records.apply_edits(w, spark.createDataFrame([(1, 0, "deletePage", ["pa0"]), (4, 0, "moveEdge", ["pa0.ed0", "coord1", "up"])], kind)).collect()
    assert {r.doc_id for r in deleted} == {4}
    edges = spark.createDataFrame([(1, 0, 0, 0.1, 0.1, 0.2, 0.2)], "doc_id bigint, page_idx int, edge_idx int, x1 double, y1 double, x2 double, y2 double")
    with pytest.raises(Exception, match="not an edge"):
        records.edited_edges(edges, spark.createDataFrame([(1, 0, "moveEdge", ["pa0", "coord1", "up"])], kind)).collect()
    assert [c for _, c, _ in records.parsed(["moveEdge pa0.ed0 coord1 up", "addWords r0 pa0.wo1", "moveEdges pa0.ed0:2 coord2 left 3"])] == ["moveEdge", "addWords", "moveEdges"]


def test_polygon_cells_against_clipping(spark):
    rng = random.Random(2)
    words = [(1, 0, k, (x := rng.randint(0, 150)), (y := rng.randint(0, 150)), x + rng.randint(1, 40), y + rng.randint(1, 40)) for k in range(120)]
    cells = [(1, 0, 0, r, c, [(c * 60 + r * 5, r * 60), (c * 60 + 60 + r * 5, r * 60 + 8), (c * 60 + 66, r * 60 + 66), (c * 60, r * 60 + 60)]) for r in range(3) for c in range(3)]
    frame = spark.createDataFrame([(*c[:5], [{"x": x, "y": y} for x, y in c[5]]) for c in cells], "doc_id bigint, page_idx int, table_idx int, row_idx int, col_idx int, polygon array<struct<x:int,y:int>>")
    found = {r.word_idx: (r.row_idx, r.col_idx) for r in tables.cells_by_polygon(spark.createDataFrame(words, "doc_id bigint, page_idx int, word_idx int, xmin int, ymin int, xmax int, ymax int"), frame).collect()}
    expected = {}
    for _, _, k, x0, y0, x1, y1 in words:
        for _, _, _, r, c, polygon in cells:
            if tables.clipped_area([(x0, y0), (x1, y0), (x1, y1), (x0, y1)], polygon) / ((x1 - x0) * (y1 - y0)) > 0.5:
                expected.setdefault(k, (r, c))
    assert found == expected and len(found) > 60


def test_edits(spark):
    lines = ["clearWord pa0.wo0", "# a remark", "replaceStr pa0.wo1 <all> 'two words'", "newWord NEW pa0.wo1 pa0.wo0", "mergeWords pa0.wo2 pa0.wo3", "splitWord pa0.wo4 fo"]
    commands = records.parsed(lines)
    assert [c for _, c, _ in commands] == ["clearWord", "replaceStr", "newWord", "mergeWords", "splitWord"]
    with pytest.raises(records.UnknownCommand, match="edits:1"):
        records.parsed(["explode pa0"])
    docs = spark.createDataFrame([(1, "The quick brown over fox")], "doc_id bigint, text string")
    edits = spark.createDataFrame([(1, s, c, a) for s, c, a in commands], "doc_id bigint, seq int, cmd string, args array<string>")
    rows = records.apply_edits(layout.words(docs), edits).orderBy("word_idx").collect()
    assert [r.text for r in rows] == ["", "two words", "brownover", "", "fo", "NEW", "x"]
    assert rows[0].orig_text == "The"


def test_records(spark):
    config = spark.createDataFrame([(1, "s", "a", "x", 1), (1, "s", "a", "y", 2)], "doc_id int, stub string, key string, value string, priority int")
    assert {(r.key, r.value) for r in records.layered_config({"a": "d", "b": "e"}, config).collect()} == {("a", "y"), ("b", "e")}
    folds = records.folds(spark.range(10).toDF("i"), F.col("i"), 3)
    assert sorted((r.i, r.fold) for r in folds.collect()) == [(i, 0 if i < 3 else 1 if i < 6 else 2) for i in range(10)]


def test_batches_are_full_and_in_order(spark):
    rng = random.Random(5)
    rows = [(d, k, rng.choice((1, 5, 20, 64, 90))) for d in range(12) for k in range(rng.randint(1, 40))]
    found = layout.batches(spark.createDataFrame(rows, "doc_id bigint, idx int, size int"), 64).collect()
    assert sorted((r.doc_id, r.idx, r.size) for r in found) == rows
    for d in range(12):
        own = sorted((r.idx, r.batch_idx, r.size) for r in found if r.doc_id == d)
        assert own[0][1] == 0 and all(b[1] - a[1] in (0, 1) for a, b in zip(own, own[1:]))
        sizes = {}
        for _, k, size in own:
            sizes.setdefault(k, []).append(size)
        assert all(sum(x) <= 64 or len(x) == 1 for x in sizes.values())
        assert all(sum(sizes[k]) + sizes[k + 1][0] > 64 for k in sizes if k + 1 in sizes)


def test_timeline(spark):
    rows = spark.createDataFrame([(1, t, v) for t, v in enumerate("aabba")], "g int, t int, v string")
    assert [(r.v, r.n) for r in timeline.scenes(rows, ("g",), "t", "v").orderBy("start").collect()] == [("a", 2), ("b", 2), ("a", 1)]
    frames = spark.createDataFrame([(1, "short"), (1, "a longer text"), (1, "another text")], "g int, text string")
    assert timeline.scene_text(frames, "g").first().text == "a longer text"


def test_pipeline(spark, docs):
    p = Pipeline.load("pipeline:\n  - component: words\n  - name: line_finder\n    cutoff: 5\n")
    assert p.names == ["words", "line_finder"] and p.has("words")
    out = p({"docs": docs})
    assert out["lines"].count() == 9 and out["provenance"].count() == 2
    with pytest.raises(PipelineError):
        Pipeline().add("nothing")
    with pytest.raises(PipelineError):
        p.add("words")
    with pytest.raises(PipelineError):
        Pipeline().add("line_finder")({"docs": docs})
    assert Pipeline().add("words").add("do_nothing", before="words").names == ["do_nothing", "words"]
    ok = Pipeline().add("quarantine", config={"most_chars": 3})({"docs": docs})
    assert {r.doc_id for r in ok["quarantine"].collect()} == {1, 3} and {r.doc_id for r in ok["docs"].collect()} == {2, 4}
    with pytest.raises(Exception, match="TextTooLong"):
        Pipeline().add("quarantine", config={"most_chars": 3, "fail_fast": True})({"docs": docs})["docs"].collect()


def test_json_and_files(spark, docs, tmp_path):
    w = layout.words(docs)
    sinks.write_json(documents.nested(w).withColumn("pdf_name", F.col("doc_id").cast("string")), str(tmp_path / "json"))
    again = documents.document_words(documents.read_documents(spark, str(tmp_path / "json")))
    assert again.count() == w.count()
    (tmp_path / "files").mkdir()
    (tmp_path / "files/a.txt").write_text("Hello big world\fSecond page")
    read = documents.read_files(spark, str(tmp_path / "files"), documents.text_reader).orderBy("page_idx", "word_idx").collect()
    assert [(r.page_idx, r.text) for r in read] == [(0, "Hello"), (0, "big"), (0, "world"), (1, "Second"), (1, "page")]


def test_pipeline_tables_and_log(spark, docs, tmp_path):
    @component(requires=("words",), assigns=("long",), depends=("json",))
    class LongWords:
        def __init__(self, least=4):
            self.least = least

        def __call__(self, bundle):
            return {"long": bundle["words"].where(F.length("text") >= self.least)}

    log = Pipeline().add("words").add("LongWords", config={"least": 5}).write({"docs": docs}, str(tmp_path / "out"))
    assert {(r.pipe, r.table, r.n_rows) for r in log.collect()} == {("words", "words", 9), ("LongWords", "long", 3)}
    assert spark.read.parquet(str(tmp_path / "out/001-LongWords/long.parquet")).count() == 3 and spark.read.parquet(str(tmp_path / "out/log.parquet")).count() == 2
    with pytest.raises(PipelineError, match="no_such_module"):
        component(depends=("no_such_module",))(LongWords)
    with pytest.raises(PipelineError, match="needs"):
        Pipeline().add("LongWords").write({"docs": docs}, str(tmp_path / "none"))


def test_copied_files_and_docx(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.bin").write_bytes(bytes([k]) * (k * 3_000_000 + 1))
    files = spark.createDataFrame([(str(tmp_path / f"{k}.bin"),) for k in range(3)], "path string")
    told = sinks.copy_files(files, str(tmp_path / "copies")).collect()
    assert sorted(r.n_bytes for r in told) == [1, 3_000_001, 6_000_001] and all((tmp_path / f"copies/{k}.bin").read_bytes() == (tmp_path / f"{k}.bin").read_bytes() for k in range(3))
    assert not list((tmp_path / "copies").glob(".*part"))
    rows = [(1, 0, "A <b> & c", True, 0), (1, 1, "two\x01", False, 240), (2, 0, "", False, 0), (2, 1, None, False, 0)]
    frame = spark.createDataFrame(rows, "doc_id bigint, seq int, text string, is_heading boolean, indent int")
    got = sorted(tuple(r) for r in sinks.docx_paragraphs(sinks.docx_files(frame)).collect())
    assert got == [(1, 0, "A <b> & c", True, 0), (1, 1, "two", False, 240), (2, 0, "", False, 0), (2, 1, "", False, 0)]


def test_stream(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "in"))
    stream = files.documents(spark, str(tmp_path / "in"), "doc_id bigint, text string")
    files.lines_to(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination()
    batch = layout.line_texts(layout.quick_lines(layout.words(docs)))
    assert spark.read.parquet(str(tmp_path / "out")).select(batch.columns).exceptAll(batch).count() == 0
