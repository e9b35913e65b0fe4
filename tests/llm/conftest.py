import json

import pytest

SAMPLES = "id string, stage string, source string, task string, first_question string, text string, payload string, simhash string, group_root string, split string"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, task string, group_id string, fetched_at timestamp_ntz"
SCHEMAS = {
    "samples": SAMPLES,
    "documents": DOCUMENTS,
    "links": "id string, key string",
    "image_bands": "band int, value int, phash string, id string",
    "source_specs": "source string, revision string, license string, stage string, task string, langs array<string>",
    "mix_targets": "source string, proportion double, max_epochs int",
    "pack_windows": "profile string, capacity int",
    "split_plan": "split string, share double",
}


def sample(i, text="", split="train", turns=None, media=None, root=None, source="s", task=None, payload=None):
    if payload is None and (turns is not None or media is not None):
        payload = json.dumps({k: v for k, v in (("turns", turns), ("media", media)) if v is not None})
    return (i, "pretrain", source, task, "", text, payload, None, root, split)


def document(i, text, source="s", lang=None):
    return (i, text, lang, source, None, None, None, None)


@pytest.fixture
def folder(spark, tmp_path):
    def write(**tables):
        for name, schema in SCHEMAS.items():
            spark.createDataFrame(tables.get(name, []), schema).write.mode("overwrite").parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
