"""Pure DataFrame to DataFrame plans over change logs; nothing here touches storage."""
