"""Literal documents through the parser: layouts, damage and odd types."""

from __future__ import annotations

import json

import pytest

from tallyfold.operators.parse import FEATURE_COLUMNS, flat_row, parse_documents


def code(source, **more):
    return {"cell_type": "code", "metadata": {}, "outputs": [], "source": source, **more}


def prose(source):
    return {"cell_type": "markdown", "metadata": {}, "source": source}


GOOD = {
    "nbformat": 4,
    "nbformat_minor": 5,
    "metadata": {
        "kernelspec": {"name": "python3", "display_name": "Python 3", "language": "python"},
        "language_info": {"name": "python", "version": "3.11.4"},
    },
    "cells": [
        prose(["# Heading\n", "Intro text.\n", "More text."]),
        code("import numpy as np\nimport pandas as pd\nimport matplotlib.pyplot as plt", execution_count=1, metadata={"tags": ["setup"]}),
        code("a = np.arange(10)", execution_count=2),
        code("plt.plot(a)", execution_count=3, outputs=[{"output_type": "display_data", "data": {"image/png": "AAAA", "text/plain": "fig"}}]),
        prose("## End\nDone."),
    ],
}
MESSY = {
    "nbformat": 4,
    "metadata": {},
    "cells": [code("import torch\n!pip install foo", execution_count=5), code("x=1", execution_count=2), code("y=2", execution_count=None)],
}
LEGACY = {
    "nbformat": 3,
    "metadata": {},
    "worksheets": [{"cells": [{"cell_type": "code", "input": "import scipy", "prompt_number": 1, "outputs": []}]}],
}
OUTPUT = {"output_type": "stream", "text": ["é \"q\" \\ 😀\n", "b"], "n": [1, 2.5, None, True]}
DOCUMENTS = {
    "good": json.dumps(GOOD),
    "messy": json.dumps(MESSY),
    "legacy": json.dumps(LEGACY),
    "malformed": '{"cells": [ {"cell_type": ',
    "blank": "",
    "spaces": "   ",
    "trailing": "{} x",
    "two_objects": "{} {}",
    "listed_objects": "{},{}",
    "glued": '{"a":1}x',
    "single_quotes": "{'nbformat': 4}",
    "empty": "{}",
    "list": "[]",
    "null": "null",
    "number": "7",
    "nan": '{"nbformat":4,"cells":[{"cell_type":"code","execution_count":NaN}]}',
    "dup": '{"nbformat":3,"nbformat":4}',
    "scalar_cell": '{"cells":[7,{"cell_type":"code","source":"a"}]}',
    "cells_obj": '{"nbformat":"4","cells":{"a":1}}',
    "bool_exec": '{"cells":[{"cell_type":"code","source":"a","execution_count":true}]}',
    "bad_meta": '{"metadata":"x"}',
    "only_md": json.dumps({"cells": [prose("a\nb\n")]}),
    "ties": json.dumps({"cells": [code("a", execution_count=n) for n in (1, 1, 2)]}),
    "null_source": '{"cells":[{"cell_type":"code","source":null,"input":"import os"}]}',
    "mixed_source": '{"cells":[{"cell_type":"code","source":["a",1,null,true]}]}',
    "blank_kernel": '{"metadata":{"kernelspec":{"name":"  "},"language_info":{"name":"julia","version":"1.9"}}}',
    "hints": json.dumps({"metadata": {"toc": {}, "colab": {}, "widgets": {"s": 1}, "kernelspec": {}}}),
    "empty_widgets": json.dumps({"metadata": {"widgets": {}}}),
    "blank_code": json.dumps({"cells": [code(" \n\t"), code(""), code("x")]}),
    "tags": '{"cells":[{"cell_type":"raw","metadata":{"tags":["b",3,true]},"source":"r"},{"cell_type":"odd","metadata":{"tags":["b"]}}]}',
    "output": json.dumps({"cells": [code("x", outputs=[OUTPUT, 3, {"output_type": "error"}, {"data": {"application/vnd.jupyter.widget-view+json": {}, "text/html": "h"}}])]}),
    "outputs_text": json.dumps({"cells": [code("x", outputs="oops")]}),
    "null_cells": json.dumps({"cells": None, "worksheets": [{"cells": [code("y")]}, 4]}),
}


@pytest.fixture(scope="module")
def parsed(spark):
    rows = spark.createDataFrame(list(DOCUMENTS.items()), "id string, raw string")
    return {r.id: r for r in parse_documents(rows).collect()}


def test_good(parsed):
    r = parsed["good"]
    assert (r.total_cells, r.code_cells, r.markdown_cells, r.nbformat) == (5, 3, 2, 4)
    assert (r.kernel_name, r.language, r.python_version, r.python_major_minor) == ("python3", "python", "3.11.4", "3.11")
    assert (r.executed_code_cells, r.max_execution_count, r.execution_order_anomalies) == (3, 3, 0)
    assert r.fully_executed_in_order and not r.has_execution_gaps
    assert r.image_outputs == 1 and r.imports == ["matplotlib", "numpy", "pandas"]
    assert r.distinct_cell_tags == ["setup"] and not r.has_custom_metadata
    assert (r.total_lines, r.code_lines, r.markdown_lines) == (10, 5, 5)
    assert (r.avg_cell_lines, r.avg_code_cell_lines, r.markdown_to_code_ratio) == (2.0, 1.667, 1.0)


def test_messy(parsed):
    r = parsed["messy"]
    assert r.parse_ok and r.executed_code_cells == 2 and r.execution_order_anomalies == 1
    assert r.has_execution_gaps and not r.fully_executed_in_order
    assert r.imports == ["torch"] and r.markdown_cells == 0


def test_legacy_layout(parsed):
    r = parsed["legacy"]
    assert (r.nbformat, r.code_cells, r.imports) == (3, 1, ["scipy"])
    assert parsed["null_cells"].code_cells == 1


@pytest.mark.parametrize("name", ["malformed", "blank", "spaces", "trailing", "two_objects", "listed_objects", "glued", "single_quotes", "list", "null", "number"])
def test_unreadable_documents_keep_a_default_row(parsed, name):
    r = parsed[name]
    assert not r.parse_ok and r.parse_error
    assert r.total_cells == 0 and r.imports == [] and r.nbformat is None
    top_level = name in ("list", "null", "number")
    assert ("not an object" in r.parse_error) == top_level


@pytest.mark.parametrize("name", ["empty", "nan", "dup", "cells_obj", "bad_meta", "hints"])
def test_readable_documents(parsed, name):
    assert parsed[name].parse_ok and parsed[name].parse_error is None


def test_odd_types(parsed):
    assert parsed["nan"].executed_code_cells == 0 and parsed["nan"].code_cells == 1
    assert parsed["dup"].nbformat == 4
    r = parsed["scalar_cell"]
    assert (r.total_cells, r.other_cells, r.code_cells) == (1, 1, 1)
    assert (parsed["cells_obj"].total_cells, parsed["cells_obj"].nbformat) == (0, 4)
    assert parsed["bool_exec"].executed_code_cells == 0
    assert not parsed["bad_meta"].has_custom_metadata


def test_ratio_without_code_is_finite(parsed):
    r = parsed["only_md"]
    assert (r.markdown_lines, r.markdown_to_code_ratio) == (2, 2.0)


def test_equal_counts_are_anomalies(parsed):
    r = parsed["ties"]
    assert (r.execution_order_anomalies, r.has_execution_gaps) == (1, True)


def test_source_forms(parsed):
    assert parsed["null_source"].total_source_chars == 0
    assert parsed["mixed_source"].total_source_chars == len("a1NoneTrue")
    assert parsed["blank_code"].empty_code_cells == 2


def test_metadata_forms(parsed):
    r = parsed["blank_kernel"]
    assert (r.kernel_name, r.language, r.python_major_minor) == (None, "julia", "1.9")
    r = parsed["hints"]
    assert r.extension_hints == ["google-colab", "jupyter-widgets", "toc"] and r.has_widget_state and r.has_custom_metadata
    assert not parsed["empty_widgets"].has_widget_state
    r = parsed["tags"]
    assert r.distinct_cell_tags == ["3", "True", "b"] and (r.raw_cells, r.other_cells) == (1, 1)


def test_outputs(parsed):
    r = parsed["output"]
    assert (r.cells_with_output, r.total_outputs, r.stream_outputs, r.error_outputs) == (1, 3, 1, 1)
    assert (r.html_outputs, r.widget_output_count, r.image_outputs) == (1, 1, 0)
    assert r.largest_output_bytes == len(json.dumps(OUTPUT))
    assert parsed["outputs_text"].cells_with_output == 0


def test_flat_row_is_json_safe(spark):
    rows = spark.createDataFrame([("good", DOCUMENTS["good"])], "id string, raw string")
    (r,) = flat_row(parse_documents(rows)).collect()
    assert r.imports == "matplotlib;numpy;pandas" and r.distinct_cell_tags == "setup"
    json.dumps(r.asDict(), allow_nan=False)
    assert len(FEATURE_COLUMNS) == 44
