"""Queries over documents write and read each file once, and kernels keep their results."""

import pandas as pd
import pytest

from docloom.pdf import content, crypto
from docloom.plans import document_queries
from docloom.sources import documents


@pytest.mark.parametrize("name", ["pdf_wrong_password", "pdf_object_streams", "pdf_compare", "pdf_compare_json"])
def test_files_are_built_once(spark, tmp_path, monkeypatch, name):
    pd.DataFrame({"conv_id": [1, 1, 2], "turn": [1, 2, 1], "role": ["u", "a", "u"], "text": ["one\ntwo", "three", "four (4)"]}).to_parquet(tmp_path / "conversations.parquet")
    log = tmp_path / "built"
    real_built = documents.built
    monkeypatch.setattr(document_queries.documents, "built", lambda rows, *a: _built_logged(real_built, rows, str(log), *a))
    assert getattr(document_queries, name)(spark, str(tmp_path)).count() in (2, 3)
    assert len(log.read_text()) == 2


def _built_logged(built, rows, log, *a):
    made = built(rows, *a)

    def run(batches):
        for b in batches:
            with open(log, "a") as f:
                f.write("x" * len(b))
            yield b

    return made.mapInPandas(run, made.schema)


def test_ciphers_and_fonts_keep_their_results():
    assert crypto.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert crypto.rc4(bytes(range(16)), bytes(300)) == crypto.rc4(bytes(range(16)) * 2, bytes(300))
    doc = type("D", (), {"get": staticmethod(lambda v: v)})
    font = content.Font(doc, {"Subtype": "Type1", "Encoding": "WinAnsiEncoding", "FirstChar": 65, "Widths": [500, 250]})
    assert font.decode(b"A\x80\x81b") == "A€�b" and font.advance(b"ABz") == 0.5 + 0.25 + 0.6
    font.differences, font.known = {65: "", 66: "ß"}, {}
    assert font.decode(b"AB\x80c") == "ß€c" and font.advance(b"AB") == 0.75
