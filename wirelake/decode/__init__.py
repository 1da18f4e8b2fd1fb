"""Protocol decoders: bytes of a frame to rows of protocol tables."""
