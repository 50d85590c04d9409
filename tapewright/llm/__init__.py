"""Operators on document text: public-tokenizer encoding, packing into containers, language labels."""
