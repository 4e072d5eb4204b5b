"""Places of the public tokenizer files. The folder is a parameter; the files are never copied."""

from __future__ import annotations

import os

#: Folder of the vocabulary files, if the environment has no other.
DEFAULT_FOLDER = "/opt/tokenizers"


def path(name: str, folder: str | None = None) -> str:
    """Full path of a vocabulary file: in `folder`, else where public_tokenizers has it, else in the default folder."""
    if folder:
        return os.path.join(folder, name)
    try:
        import public_tokenizers
    except ImportError:
        return os.path.join(DEFAULT_FOLDER, name)
    return public_tokenizers.path(name)
