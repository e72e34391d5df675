"""What the operators bring to the driver: few places, each with a bound that does not grow with the documents."""

from pathlib import Path

FOLDER = Path(__file__).resolve().parents[2] / "gradebook" / "llm"

#: A row per shingle length; a bitmap's words; the bins of a classifier; the buckets of a regression.
GATHERED = {"decontaminate.py": 1, "bitmaps.py": 1, "site_quality.py": 1, "url_filters.py": 1}


def test_few_places_gather_rows():
    texts = {path.name: path.read_text() for path in FOLDER.glob("*.py")}
    found = {name: text.count(".collect()") + text.count(".toPandas(") for name, text in texts.items()}
    assert {name: n for name, n in found.items() if n} == GATHERED
    assert not any("localCheckpoint" in text or "crossJoin" in text for text in texts.values())
