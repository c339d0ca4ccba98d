"""Text operators for preparing training corpora at scale.

Each module holds one operator with its general interface and the thin
``opN_<name>`` query built on it; ``registry`` lists the queries.
"""
