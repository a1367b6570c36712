"""Operators that prepare text corpora for training, and the queries over them.

Every operator takes a DataFrame of documents (``doc_id``, ``text`` and whatever
else the operator names) and reads only the columns it needs, so further columns
may have any name. Nothing else in the library imports this subpackage."""
