import os

import pytest

from skerry.llm import tokenize


@pytest.fixture(scope="session")
def vocabulary():
    path = tokenize.vocabulary_path()
    if not os.path.exists(path):
        pytest.skip("no public vocabulary here")
    return path


@pytest.fixture(scope="session")
def public(vocabulary):
    """The public library's own encoder, as ids of a text."""
    import base64

    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenize.BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
