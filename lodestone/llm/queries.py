"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .boosted import op11_quality
from .bpe import op6_bpe
from .chat import OP5_SQL, op5_chat
from .html import op7_html
from .langid import op8_langid
from .migrate import op12_migrate
from .minhash import op2_minhash
from .packing import op4_packing
from .quality import op3_quality
from .simhash import op1_simhash
from .spelling import op13_spelling
from .urls import OP10_SQL, op10_urls
from .warc import op9_warc

QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_minhash": op2_minhash,
    "op3_quality": op3_quality,
    "op4_packing": op4_packing,
    "op5_chat": op5_chat,
    "op6_bpe": op6_bpe,
    "op7_html": op7_html,
    "op8_langid": op8_langid,
    "op9_warc": op9_warc,
    "op10_urls": op10_urls,
    "op11_quality": op11_quality,
    "op12_migrate": op12_migrate,
    "op13_spelling": op13_spelling,
}

SQL: dict[str, str] = {"op5_chat": OP5_SQL, "op10_urls": OP10_SQL}
