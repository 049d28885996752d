"""The documents, dressed with snippets that make the text rules fire; one SQL text for every engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRESSED = """
select d.doc_id, d.lang, d.source,
 replace(d.text, chr(10), chr(10)||chr(10)) || chr(10)||chr(10) || s.snip || chr(10)||chr(10) || 'Ende.' as text
 from documents d join (select * from (values (0, 'Siehe https://example.org/a?b=1, dort steht mehr. Schreiben Sie an info@example.org .'),
(1, 'Kapitel 3 Der Anfang'||chr(10)||'12'||chr(10)||'-----'||chr(10)||'Das kostet ca. 3.5 Euro, d.h. max. 4 Euro bzw. weniger.'),
(2, 'Inhalt ........ 7'||chr(10)||'Teil 2 Mitte ..... 19'),
(3, '- Apfel'||chr(10)||'* Birne'||chr(10)||'- Kirsche'),
(4, 'Die Ver-'||chr(10)||'bindung  ist   gut .'),
(5, 'Das ist belegt [1, 2] (Müller 2020: 15) und (vgl. Abb. 3 dort) klar.'),
(6, 'KURZE PAUSE, um zu atmen'||chr(10)||'Weiter im Text.'||chr(10)||'STILLE'),
(7, '(Pause: 30 Sek)'||chr(10)||'Nun folgt [1,5 Minuten] Ruhe.'||chr(10)||'NACHSPÜREN fünf Minuten'),
(8, 'Manche Regie nennt das Chakra ein Regime.'||chr(10)||'Prof. Dr. Weber kam, z.B. heute.'),
(9, 'Seite 12'||chr(10)||'***'||chr(10)||'Ein'||chr(9)||'Tab( innen ) hier'),
(10, '[PAUSE 2s] Schon getaggt. Noch ein Satz! Und noch einer?'),
(11, 'Hinweis: nichts zu tun. Im Cafe\u0301 gibt es Mu\u0308sli.'),
(12, 'PAUSE Teil2'||chr(10)||'PAUSE 3x tief'||chr(10)||'pause 12.5, dann'||chr(10)||'[PAUSE 0s]'||chr(10)||'Kurze Stille: 0,3 Sekunden'||chr(10)||'(0 Min) und [PAUSE 2 s] und (Pause hier) dann'),
(13, 'Seite12'||chr(10)||'  eingerückt  '||chr(10)||'(Pause hier) dann weiter'||chr(10)||'Siehe HTTP://X.ORG/A und WWW.Y.ORG'||chr(9)||'.'||chr(10)||'VER-  '||chr(10)||'  BINDUNG')) v(k, snip)) s on s.k = d.doc_id % 14
"""


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def dressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and text."""
    return spark.sql(DRESSED.replace("from documents d", "from {documents} d"), documents=documents(spark, sf_dir))
