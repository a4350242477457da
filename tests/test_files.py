"""Listings of large and odd files, and documents that can't be read."""

import hashlib
import zipfile

from curatrix.sources import files

NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def document(at, *texts):
    at.parent.mkdir(parents=True, exist_ok=True)
    body = "".join(f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>" for t in texts)
    with zipfile.ZipFile(at, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{NS}"><w:body>{body}</w:body></w:document>')


def test_large_files_are_streamed(spark, tmp_path):
    """A sparse file of over 2 GB is hashed though no row could hold it."""
    big, size = tmp_path / "a b" / "big.bin", (2 << 30) + 4097
    big.parent.mkdir()
    with big.open("wb") as f:
        f.truncate(size)
        f.write(b"head")
    (tmp_path / "small.txt").write_bytes(b"text")
    (tmp_path / "a b" / "no bytes %20.txt").write_bytes(b"")
    got = {r.relative_path: r for r in files.scan_files(spark, str(tmp_path), "r").collect()}
    want, zeros, left = hashlib.sha256(b"head"), bytes(1 << 24), size - 4
    while left:
        n = min(left, len(zeros))
        want.update(zeros[:n])
        left -= n
    assert got["a b/big.bin"].content_hash == f"sha256:{want.hexdigest()}" and got["a b/big.bin"].size == size
    assert got["small.txt"].content_hash == f"sha256:{hashlib.sha256(b'text').hexdigest()}"
    assert got["a b/no bytes %20.txt"].content_hash == f"sha256:{hashlib.sha256(b'').hexdigest()}" and got["a b/no bytes %20.txt"].modified_at is not None
    assert {r.error for r in got.values()} == {None} and len(got) == 3


def test_a_file_that_no_opener_reads_is_a_row_with_an_error(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"0123456789")

    def refuse(path):
        raise PermissionError(f"not allowed: {path}")

    row = files.scan_files(spark, str(tmp_path), opener=refuse, whole_bytes=4).first()
    assert row.content_hash is None and "not allowed" in row.error and row.size == 10
    assert files.scan_files(spark, str(tmp_path), whole_bytes=4).first().content_hash == f"sha256:{hashlib.sha256(b'0123456789').hexdigest()}"


def test_every_unreadable_document_is_a_row(spark, tmp_path):
    document(tmp_path / "one" / "1990" / "d.docx", "first", " ", "second")
    document(tmp_path / "two" / "1990" / "d.docx", "other")
    document(tmp_path / "empty.docx")
    document(tmp_path / "whole.docx", *(f"text {i}" for i in range(400)))
    whole = (tmp_path / "whole.docx").read_bytes()
    (tmp_path / "truncated.docx").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "nothing.docx").write_bytes(b"")
    locked = bytearray((tmp_path / "two" / "1990" / "d.docx").read_bytes())
    for mark, at in ((b"PK\x03\x04", 6), (b"PK\x01\x02", 8)):
        locked[locked.index(mark) + at] |= 1  # the flag of encrypted members
    (tmp_path / "encrypted.docx").write_bytes(bytes(locked))
    broken = bytearray(whole)
    with zipfile.ZipFile(tmp_path / "deflated.docx", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<x>" + "abc" * 500)
    broken = bytearray((tmp_path / "deflated.docx").read_bytes())
    broken[60:80] = b"\xff" * 20
    (tmp_path / "stream.docx").write_bytes(bytes(broken))
    (tmp_path / "deflated.docx").unlink()
    with zipfile.ZipFile(tmp_path / "parts.docx", "w") as z:
        z.writestr("other.xml", "<x/>")
    rows = files.extract_paragraphs(spark, str(tmp_path)).collect()
    assert {(r.folder, r.document, r.pos, r.text) for r in rows if r.error is None and r.document == "d.docx"} == {("one/1990", "d.docx", 0, "first"), ("one/1990", "d.docx", 1, "second"), ("two/1990", "d.docx", 0, "other")}
    assert {r.document for r in rows if r.error is not None} == {"truncated.docx", "nothing.docx", "encrypted.docx", "stream.docx", "parts.docx"}
    assert "empty.docx" not in {r.document for r in rows}
    assert {r.error for r in files.extract_paragraphs(spark, str(tmp_path), largest=100).collect()} >= {"too large"}
