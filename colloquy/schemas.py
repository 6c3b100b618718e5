"""Schemas of the documents that come in and of the tables that are built."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType


def fields(text: str = "", lists: str = "", longs: str = "", ints: str = "", **nested: StructType) -> StructType:
    """A struct of named string, string-array, long and int fields, and arrays of structs."""
    kinds = [(text, StringType()), (lists, ArrayType(StringType())), (longs, LongType()), (ints, IntegerType())]
    out = [StructField(n, k) for names, k in kinds for n in names.split()]
    return StructType(out + [StructField(n, ArrayType(k)) for n, k in nested.items()])


EVOLUTION = fields("date note")
MODEL = fields("id category title desc evidence quote first_seen last_seen", "holders about people related", "count")
PERSON = fields("name type role org summary evidence", "models", evolution=EVOLUTION)
ONTOLOGY = StructType(
    [
        StructField("meta", fields("title org subtitle date_range sensitivity confidence_note", "sources processed_source_ids", "schema_version")),
        *fields(
            meetings=fields("id date title source_id path batch"),
            people=PERSON,
            models=MODEL,
            relations=fields("from to type direction topic note"),
            network=fields("a b kind since note source"),
            bets=fields("tag title desc status owner date", "source related_models"),
            risks=fields("level title desc status mitigation", "source"),
            timeline=fields("date meeting change"),
        ).fields,
    ]
)
#: `personal` holds texts and objects: it is read as raw JSON.
REGISTRY = fields("name role org traits tier relationship team manager first_met_context intro_by", "aliases meetings personal")
INSTANCE = fields("holder title category quote evidence", "about")
EXTRACT = StructType(
    [
        StructField("batch", StringType()),
        StructField(
            "meetings",
            ArrayType(
                fields(
                    "source_id date title timeline_signal",
                    instances=INSTANCE,
                    tensions=fields("from to topic note direction"),
                    network_facts=fields("a b kind note"),
                )
            ),
        ),
    ]
)
SYNTHESIS = StructType([StructField("key", StringType()), StructField("summary", StringType()), StructField("models", ArrayType(MODEL)), StructField("evolution", ArrayType(fields("person date note")))])
RECORDER = StructType([StructField("items", ArrayType(fields("type speaker text", "", "start")))])

#: The built tables. `relations.direction`, the lists of bets and the ontology's meetings are kept too.
TABLES = {
    "people": fields("name type role org summary evidence tier relationship team manager"),
    "models": fields("id category title desc evidence quote first_seen last_seen", "", "count"),
    "model_people": fields("model_id person"),
    "model_about": fields("model_id entity"),
    "model_related": fields("model_id related_id"),
    "person_aliases": fields("canonical alias"),
    "relations": fields("from_person to_person type topic note direction"),
    "network": fields("a b kind since note source"),
    "person_meetings": fields("person src", "", "meeting_rowid"),
    "timeline": fields("date meeting change"),
    "bets": fields("tag title desc status owner date source", "related_models"),
    "risks": fields("level title desc status mitigation source"),
    "commitments": fields("from_person to_person text due", "", "meeting_rowid", "done"),
    "meetings": fields("source_id part date title category category_raw transcribed_by path participants", "", "rowid duration_min"),
    "utterances": fields("speaker speaker_raw ts text kind", "", "utt_id meeting_rowid"),
    "onto_meetings": fields("id date title source_id path"),
}
