"""Operators over documents: schemas, rules, HL7 messages, shaping and iteration."""
