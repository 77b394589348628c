from pulsegrid.sources.masks import read_masks, write_masks


def test_mask_text(spark, tmp_path):
    (tmp_path / "m.txt").write_text("(artstart,artstop)\n(2978.61, 3348.16)\n\nsaturation artifacts\n4155.07\n")
    got = read_masks(spark, str(tmp_path / "m.txt"))
    want = {(2978610000, 3348160000, "stretch"), (4155070000, 4155070000, "point")}
    assert {(r.start, r.stop, r.kind) for r in got.collect()} == want
    write_masks(got, str(tmp_path / "out"))
    assert {(r.start, r.stop, r.kind) for r in read_masks(spark, str(tmp_path / "out")).collect()} == want
    (tmp_path / "none.txt").write_text("")
    assert read_masks(spark, str(tmp_path / "none.txt")).count() == 0
