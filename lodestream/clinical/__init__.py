"""Clinical messages: HL7v2 text and FHIR R4 JSON, parsed by column expressions."""
