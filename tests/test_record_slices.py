"""A batch of article records is parsed a few MB at a time."""

import pyarrow as pa

from quire.sources.xml_parse import SLICE_BYTES, _parse


def test_a_large_batch_is_parsed_in_slices():
    sizes = [10, SLICE_BYTES // 2, SLICE_BYTES // 2, 3 * SLICE_BYTES, 5, 5, SLICE_BYTES]
    xml = [f"<PubmedArticle><PMID>{i}</PMID><ArticleTitle>{'t' * n}</ArticleTitle></PubmedArticle>" for i, n in enumerate(sizes)]
    batch = pa.RecordBatch.from_arrays([pa.array(xml), pa.array(["f"] * 6 + ["g"]), pa.array([0] * 7, pa.int64())], ["xml", "file", "block"])
    out = list(_parse([batch, batch.slice(6)]))
    assert all(b.num_rows == 1 or b.nbytes < SLICE_BYTES + 1000 for b in out)
    rows = pa.Table.from_batches(out).to_pylist()
    assert [(int(r["pmid"]), len(r["title"]), r["row"]) for r in rows] == [
        *[(i, n, i if i < 6 else 0) for i, n in enumerate(sizes)], (6, sizes[6], 1)]
