import pytest

from threadweave.session import import_on_workers

POSTS = "tweet_id string, text string"


@pytest.fixture(scope="session")
def posts(spark):
    import_on_workers(spark)

    def make(rows, schema=POSTS):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture(scope="session")
def tokenizer_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def library(tokenizer_path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path)
