"""Operations over chunks: one pass with bounded memory."""
