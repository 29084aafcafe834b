"""A folder with good, damaged and foreign files through the dispatch and the command line."""

from quire import __main__ as cli
from quire.functions.folds import ChunkConfig
from quire.sources import batch

from test_docx import docx, par


def folder(tmp_path):
    body = par("Some words that a reader may want to find again later.")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    for name, content in {
        "a.docx": docx(par("Scope", num=("1", 0)), body, par("Terms", num=("1", 0)), body),
        "sub/a.docx": docx(body, body),
        "empty.docx": docx(),
        "bad.docx": b"not a zip file",
        "scan.pdf": b"%PDF-1.4",
        "~$a.docx": b"lock",
    }.items():
        (tmp_path / "in" / name).write_bytes(bytes(content))
    return str(tmp_path / "in"), str(tmp_path / "out")


def test_one_bad_file_stops_nothing(spark, tmp_path):
    src, out = folder(tmp_path)
    done = batch.process(spark, src, out, ChunkConfig(min_tokens=1))
    rows = {r["path"].split("/in/")[1]: r for r in done.report.collect()}
    assert set(rows) == {"a.docx", "sub/a.docx", "empty.docx", "bad.docx", "scan.pdf"}
    assert {k for k, r in rows.items() if r["error"]} == {"bad.docx", "scan.pdf"}
    assert rows["scan.pdf"]["error"] == "no reader for .pdf files" and rows["empty.docx"]["n_chunks"] == 0
    chunks = done.chunks.collect()
    assert len(chunks) == sum(r["n_chunks"] for r in rows.values()) and done.exit_code == 0
    assert {r["source_file"] for r in chunks} == {"a.docx"} and len({r["doc_id"] for r in chunks}) == 2
    assert {r["section_title"] for r in chunks if r["doc_id"] == rows["a.docx"]["doc_id"]} == {"Scope", "Terms"}


def test_merged_chunks_are_the_same(spark, tmp_path):
    src, out = folder(tmp_path)
    text = lambda d: sorted((r["chunk_id"], r["text"]) for r in d.chunks.collect())
    assert text(batch.process(spark, src, out)) == text(batch.process(spark, src, out + "2", merge=True))


def test_command_line(spark, tmp_path, capsys):
    src, out = folder(tmp_path)
    assert cli.main([src, "-o", out, "--keep-short-sections", "--outline", "--preview", "1"]) == 0
    shown = capsys.readouterr()
    assert "Scope" in shown.out and "--- a-" in shown.out and "bad.docx" in shown.err
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "b.docx").write_bytes(b"x")
    assert cli.main([str(tmp_path / "bad"), "-o", out + "3"]) == 1
    (tmp_path / "none").mkdir()
    assert cli.main([str(tmp_path / "none"), "-o", out + "4"]) == 1
