"""Training-data operators: de-duplication, cleaning, mixing, formatting, scoring and encoding.

Nothing outside this subpackage imports it.  Each module holds one operator with a general
interface; :mod:`shapeloom.llm.queries` derives the contract queries from them.
"""
