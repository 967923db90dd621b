"""The object for a set of archives, on one made by hand."""

import pytest

from assetspark.api import AssetError, Assets
from assetspark.operators.catalog import VariantQuery
from assetspark.sources import archive as A


@pytest.fixture(scope="module")
def assets(spark):
    gray = lambda name, w, h, pixels, scale=100: A.encode_rendition(w, h, scale, "GRAY", 12, name, b"", A.encode_raster(0, pixels))
    renditions = [
        ([1, 1, 0], gray("icon.png", 4, 2, bytes(range(8)))),
        ([1, 2, 0], gray("icon.png", 8, 4, bytes(range(32)), 200)),
        ([2, 1, 0], A.encode_rendition(0, 0, 100, "None", 1009, "tint", b"", A.encode_color(1, [1.0, 0.0, 0.5, 1.0]))),
        ([3, 1, 0], A.encode_rendition(0, 0, 100, "SVG ", 9, "shape.svg", b"", A.encode_raw(b"<svg/>"))),
    ]
    made = Assets.load(spark, A.encode([17, 12, 15], [("Icon", [(17, 1)]), ("Tint", [(17, 2)]), ("Shape", [(17, 3)])], renditions), "a.car")
    yield made.check()
    made.close()


def test_lists_and_reports(assets):
    assert assets.document_info().first()["AssetStorageVersion"] == 17
    assert [r.id for r in assets.list_entries().orderBy("entry_index").collect()] == [f"entry-{k}" for k in range(4)]
    assert assets.list_images().count() == 3 and assets.list_image_summaries().count() == 3 and assets.list_entry_summaries().count() == 4
    assert {r.rendition_name for r in assets.search("SHAPE").collect()} == {"shape.svg"} and assets.search(" ").count() == 4
    total = assets.diagnostics_summary().first()
    assert (total.facets, total.entries, total.unsupported_outputs) == (3, 4, 1) and [s.issue for s in total.issue_samples] == ["Unsupported:Encoding:None"]
    assert assets.with_issues().count() == 1 and assets.rendition_infos().count() == 4 and assets.info_json().count() == 5
    assert assets.export_plan().where("outcome = 'Planned'").count() == 4 and assets.resolved_references().count() == 0


def test_variants(assets):
    assert assets.best_variant("Icon").scale == 1 and assets.best_variant("Icon", VariantQuery(scale=2)).scale == 2
    assert assets.variants_for(0).count() == 2 and assets.entry(3).facet_name == "Tint" and assets.with_key([3, 1, 0]).count() == 1
    for call, code in ((lambda: assets.best_variant("None"), "AssetNotFound"), (lambda: assets.best_variant("Icon", VariantQuery(idiom=4)), "NoMatch"), (lambda: assets.best_variant("Icon", VariantQuery(scale=3)), "NoMatch"), (lambda: assets.entry(9), "EntryNotFound")):
        with pytest.raises(AssetError) as e:
            call()
        assert e.value.code == code


def test_payloads_by_id(assets):
    assert bytes(assets.get_display_payload("entry-0").data)[:8] == bytes([0, 0, 0, 255, 1, 1, 1, 255])
    assert assets.get_display_payload("entry-2").kind == "img-binary" and assets.get_display_payload("entry-3").css_color == "rgba(255, 0, 128, 1.0000)"
    assert bytes(assets.get_download_payload("entry-2").data) == b"<svg/>" and bytes(assets.get_download_payload("entry-1").data).startswith(b"\x89PNG")
    small = assets.get_thumbnail_payload("entry-1", 4)
    assert (small.mime, small.p_width, small.p_height) == ("image/png", 4, 2) and bytes(assets.get_thumbnail_payload("entry-2").data) == b"<svg/>"
    assert assets.decoded().count() == 4 and assets.pictures("rgba").where("error_code IS NULL").count() == 2 and assets.originals().where("data IS NOT NULL").count() == 1
    for call, code in ((lambda: assets.get_download_payload("entry-3"), "EntryNotDownloadable"), (lambda: assets.get_entry_info("entry-9"), "EntryNotFound")):
        with pytest.raises(AssetError) as e:
            call()
        assert e.value.code == code


def test_extract_raises_for_failed_assets(spark, assets, tmp_path):
    assert assets.extract(str(tmp_path / "x")).first().saved == 4
    bad = Assets.load(spark, A.encode([17], [("Bad", [(17, 1)])], [([1], A.encode_rendition(1, 1, 100, "GRAY", 12, "bad.png", b"", A.encode_raster(1, b"?")))]))
    with pytest.raises(AssetError, match="1 failed"):
        bad.extract(str(tmp_path / "y"))
    with pytest.raises(AssetError, match="InvalidArchive"):
        Assets.load(spark, b"no archive").check()
