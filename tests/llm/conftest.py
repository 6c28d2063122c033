import pytest

pytest.importorskip("knotwork.llm")
