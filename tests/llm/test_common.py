import pyarrow as pa
import pyarrow.compute  # noqa: F401

from millrace.llm.common import slices


def test_slices_keep_all_rows_of_text_and_list_columns():
    for column in (pa.array(["ab" * i for i in range(50)] + [None]), pa.array([[1] * i for i in range(50)] + [None])):
        batch = pa.RecordBatch.from_arrays([column], names=["x"])
        pieces = list(slices(batch, 0, 64))
        assert len(pieces) > 5
        assert [v for p in pieces for v in p.column(0).to_pylist()] == column.to_pylist()
