"""Protobuf payloads, for journals that store bytes instead of JSON.

They are parsed by Spark's own ``from_protobuf``, whose jar (spark-protobuf) is
not part of PySpark; the descriptor is built here from the schemas.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import types as T
from pyspark.sql.protobuf.functions import from_protobuf

from courtledger import schemas

# Field numbers follow the order of the schemas, from 1.
_MESSAGES = {
    "Total": (schemas.TOTAL, schemas.REQUIRED_TOTAL),
    "Line": (schemas.LINE, schemas.REQUIRED_LINE),
    "Result": (schemas.RESULT, schemas.REQUIRED_RESULT),
    "Event": (schemas.EVENT, schemas.EVENT.fieldNames()),
}


@functools.cache
def descriptor() -> bytes:
    """The descriptor set of an event, built from the schemas."""
    try:
        from google.protobuf import descriptor_pb2
    except ImportError as error:
        raise ImportError("protobuf payloads need the google.protobuf package") from error

    kinds = descriptor_pb2.FieldDescriptorProto
    scalars = {"string": kinds.TYPE_STRING, "int": kinds.TYPE_INT32, "bigint": kinds.TYPE_INT64}
    names = {schema.simpleString(): name for name, (schema, _) in _MESSAGES.items()}
    file = descriptor_pb2.FileDescriptorProto(name="courtledger_event.proto", syntax="proto2")
    for name, (schema, required) in _MESSAGES.items():
        message = file.message_type.add(name=name)
        for number, field in enumerate(schema.fields, start=1):
            repeated = isinstance(field.dataType, T.ArrayType)
            kind = (field.dataType.elementType if repeated else field.dataType).simpleString()
            added = message.field.add(name=field.name, json_name=field.name, number=number)
            added.label = (
                kinds.LABEL_REPEATED if repeated
                else kinds.LABEL_REQUIRED if field.name in required
                else kinds.LABEL_OPTIONAL
            )
            if kind in scalars:
                added.type = scalars[kind]
            else:
                added.type = kinds.TYPE_MESSAGE
                added.type_name = f".{names[kind]}"
    return descriptor_pb2.FileDescriptorSet(file=[file]).SerializeToString()


def parsed_event(payload: Column) -> Column:
    """Event bytes as the nested event, null where they do not parse.

    Without the jar Spark raises an error that names the package to add.
    """
    return from_protobuf(payload, "Event", options={"mode": "PERMISSIVE"}, binaryDescriptorSet=descriptor())
