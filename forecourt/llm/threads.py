"""Threads of numpy's linear algebra inside tasks."""

from __future__ import annotations

import ctypes
import glob
import os
from functools import lru_cache

import numpy as np

# What the libraries that come with numpy call this function.
_SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads")


@lru_cache(maxsize=1)
def one_thread() -> bool:
    """Let products in this process run on one thread; True if the library could be told.

    A task has one core.  By default each worker starts as many threads as its executor has
    cores, which for matrices as small as those of a window only wait for one another: the
    training of the language model takes twice the CPU time with two.
    """
    folder = os.path.dirname(np.__file__)
    told = False
    for path in glob.glob(f"{folder}.libs/*openblas*") + glob.glob(f"{folder}/.dylibs/*openblas*"):
        library = ctypes.CDLL(path)
        for name in _SETTERS:
            setter = getattr(library, name, None)
            if setter is not None:
                setter(ctypes.c_int(1))
                told = True
    return told
