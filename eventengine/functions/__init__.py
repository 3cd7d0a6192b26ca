"""Column functions. None of them needs Python on the executors, but for those of ``similarity`` and ``markup``."""
