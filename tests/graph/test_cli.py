from test_turtle import PREFIX

from shapeloom.__main__ import main

SHAPES = PREFIX + "ex:S sh:targetSubjectsOf ex:k ; sh:property [ sh:path ex:k ; sh:maxCount 1 ] ."


def test_inspect_and_version(tmp_path, capsys):
    (tmp_path / "s.ttl").write_text(SHAPES)
    assert main(["version"]) == 0 and main(["inspect", "--shapes", str(tmp_path / "s.ttl")]) == 0
    assert "<http://ex/S> (subjectsOf <http://ex/k>)" in capsys.readouterr().out


def test_validate(spark, tmp_path, capsys):
    (tmp_path / "s.ttl").write_text(SHAPES)
    (tmp_path / "d.ttl").write_text(PREFIX + "ex:a ex:k 1, 2 . ex:b ex:k 1 .")
    args = ["validate", "--shapes", str(tmp_path / "s.ttl"), "--data", str(tmp_path / "d.ttl"), "--format", "json"]
    assert main(args) == 1
    out = capsys.readouterr().out
    assert '"conforms": false' in out and "http://ex/a" in out and "http://ex/b" not in out
