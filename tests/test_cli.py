"""The command line on an existing session."""

import io

from veilframe.__main__ import main


def test_text_lines_and_json(spark, capsys, tmp_path, monkeypatch):
    assert main(["write", "to", "a@b.org"]) == 0
    assert capsys.readouterr().out == "write to <PRIVATE_EMAIL>\n"
    (tmp_path / "x.txt").write_bytes(b"one a@b.org\n\nthree")
    assert main(["--lines", "-f", str(tmp_path / "x.txt"), "--stats"]) == 0
    got = capsys.readouterr()
    assert got.out == "one <PRIVATE_EMAIL>\n\nthree\n" and got.err.startswith("records 3")
    assert main(["--json", "say a@b.org"]) == 0
    assert capsys.readouterr().out == '{"spans":[{"label":"private_email","start":4,"end":11,"text":"a@b.org"}]}\n'
    assert main(["--dump-tokens", "a b"]) == 0
    assert len(capsys.readouterr().out.split()) == 2

    class Stdin:
        buffer = io.BytesIO(b"")

    monkeypatch.setattr("sys.stdin", Stdin)
    assert main(["-f", "-"]) == 0
    assert capsys.readouterr().out == ""
